"""Spark-native table profiling and domain analytics."""
