"""locusframe: structural-variant analytics as Spark DataFrame queries."""
