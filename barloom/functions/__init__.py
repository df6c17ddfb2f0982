"""Column expressions: they take columns and return columns."""
