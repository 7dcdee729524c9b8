"""Column expressions: text, hashing and similarity kernels."""
