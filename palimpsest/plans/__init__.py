"""Named queries over the test tables, with the same in DuckDB's SQL."""
