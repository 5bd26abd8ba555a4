"""Column-level text functions built from Spark expressions."""
