"""Column expressions: falsy coalescing, normalisation, metrics and display text."""
