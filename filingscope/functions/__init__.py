"""Column functions: text, hashing and scoring."""
