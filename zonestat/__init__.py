"""Spark-native place-based statistics for gridded and point data."""
