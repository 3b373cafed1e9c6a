"""Operators: generators, relations, simulation, damage, patches, validation, duplicates."""
