"""Column expressions over reads."""
