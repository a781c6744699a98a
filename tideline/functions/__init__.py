"""Column expressions: value cleaning, row hashing, names."""
