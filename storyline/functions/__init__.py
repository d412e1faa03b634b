"""Column expressions: every function maps columns to a column, no Python workers."""
