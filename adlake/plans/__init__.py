"""Named queries: each operator run over the given tables, with an equal DuckDB query."""
