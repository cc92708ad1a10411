"""Relational operators: profiling, quality, joins, seasonality checks, governance."""
