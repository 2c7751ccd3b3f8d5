"""Spark-native analytics over site-grouped text corpora."""
