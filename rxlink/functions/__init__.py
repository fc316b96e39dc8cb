"""Column functions: text, extractors, similarity."""
