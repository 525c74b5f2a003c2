"""Column expressions: addresses, points, text and colours."""
