"""Column functions and aggregates built from Spark's own expressions."""
