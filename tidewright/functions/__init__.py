"""Column expressions: counter-based random numbers, samplers, calendar parts, text shapes."""
