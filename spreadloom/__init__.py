"""Spark-native analytics for ladders of related contracts and other multi-leg time series."""
