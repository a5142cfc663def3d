"""Column expressions: cell conversion, text, calendar and the metric library."""
