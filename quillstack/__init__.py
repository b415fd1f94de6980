"""Spark-native operators for operational documents: sync, resolution, parsing, expansion, ranking, scoring."""
