"""Mean-reversion strategy research on price bars, expressed as Spark jobs."""
