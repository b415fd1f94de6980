"""Joins that Spark would otherwise plan as nested loops, rewritten over keys that it can hash."""
