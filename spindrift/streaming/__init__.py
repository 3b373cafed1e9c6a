"""Live generation: rates, an unbounded source of record indexes, sinks."""
