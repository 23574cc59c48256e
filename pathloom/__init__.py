"""Path-set analytics expressed as Spark DataFrame jobs."""
