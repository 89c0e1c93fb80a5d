"""Document-verification analytics as Spark DataFrame operations."""
