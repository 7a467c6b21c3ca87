"""Column functions: hashing, text and vectors."""
