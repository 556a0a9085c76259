"""Column functions: text, parsing, ranking."""
