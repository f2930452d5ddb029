"""Document-library analytics expressed as Spark DataFrame, SQL and Structured Streaming jobs."""
