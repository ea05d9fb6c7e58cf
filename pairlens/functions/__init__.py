"""Column functions: text, lists, similarity."""
