"""State analytics as Spark DataFrame jobs."""
