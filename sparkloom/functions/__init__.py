"""Column functions that give exactly DuckDB's answers where Spark's own differ."""
