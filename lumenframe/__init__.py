"""Spark-native analytics over image catalogs, feature vectors and measured properties."""
