"""Spark-native analytics over daily entity-by-date panels."""
