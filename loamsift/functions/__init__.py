"""Column functions on text and hashes."""
