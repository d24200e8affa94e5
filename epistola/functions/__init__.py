"""Column functions: text folding and matching, message parsing, formats."""
