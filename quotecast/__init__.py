"""Price and lead-time analytics over purchase history, as Spark DataFrame jobs."""
