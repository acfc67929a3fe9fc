"""Column expressions: text normalisation and cleaning, article links, metric formulas."""
