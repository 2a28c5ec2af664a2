"""Assaykit: Spark-native evaluation analytics."""
