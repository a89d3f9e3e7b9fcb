"""Column expressions: text, dates, HTML and feature columns."""
