"""Spark-native embedding, spectral and volume analytics."""
