"""Spark-native analytics for personal library catalogues and text corpora."""
