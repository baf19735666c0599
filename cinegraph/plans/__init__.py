"""Table catalog, named queries and their DuckDB oracle SQL."""
