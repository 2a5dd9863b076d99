"""Column expressions: text, time and price functions."""
