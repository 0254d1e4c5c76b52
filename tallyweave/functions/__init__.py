"""Column expressions: money, time, identifiers."""
