"""Column functions beyond Spark's own."""
