"""Column expressions: markup cleaning and tokens."""
