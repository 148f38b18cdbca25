"""Column expressions of document review."""
