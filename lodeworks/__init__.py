"""Spark-native analytics over a versioned object log."""
