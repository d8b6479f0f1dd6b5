"""Column functions: text, vectors, hashes."""
