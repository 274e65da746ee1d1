"""Spark-native analytics over governed document repositories."""
