"""Column expressions and the fixed word lists they use."""
