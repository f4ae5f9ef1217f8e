"""Column expressions: everything here is row-wise or an aggregate expression."""
