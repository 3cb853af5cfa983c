"""Spark-native entity resolution and data preparation."""
