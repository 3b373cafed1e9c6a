"""Scalar building blocks: uniforms, types, expressions, filters and transforms as Columns."""
