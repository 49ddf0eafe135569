"""Road-accident analytics as Spark DataFrame jobs."""
