"""Spark-native analytics for brightness time series and training-data corpora."""
