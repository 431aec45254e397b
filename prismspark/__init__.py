"""Spark-native media screening analytics."""
