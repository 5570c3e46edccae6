"""Spark-native operators for preparing narrated-text corpora."""
