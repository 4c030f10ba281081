"""Spark-native hybrid search and document analytics."""
