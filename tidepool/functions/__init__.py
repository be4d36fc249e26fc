"""Column expressions over sequences and qualities."""
