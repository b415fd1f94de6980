"""Column expressions. Every function takes and returns columns and stays inside Spark's own expressions."""
