"""Spark-native operators for long-form text corpora."""
