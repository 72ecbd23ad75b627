"""Spark-native analytics over time-aligned text, event intervals and per-entity measurements."""
