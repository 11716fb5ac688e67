"""Column functions: text cleanup, parsers, similarities."""
