"""Column expressions: text, numbers, dates."""
