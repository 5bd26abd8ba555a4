"""granthika: retrieval and document analytics as Spark DataFrame jobs."""
