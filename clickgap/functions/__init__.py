"""Column expressions: text, URL, number parsing, regex rules."""
