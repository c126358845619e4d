"""Column expressions: geometry, statistics, text and labels."""
