"""Spark-native analytics for media-highlight tables."""
