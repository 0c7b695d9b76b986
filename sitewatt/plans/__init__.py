"""Named queries over the fixture (Spark) and their DuckDB oracle SQL."""
