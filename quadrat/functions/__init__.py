"""Column expressions and probability distributions."""
