"""Column functions: text, vectors, time and keys."""
