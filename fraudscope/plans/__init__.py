"""Query catalogue: every registered query and its DuckDB oracle SQL."""
