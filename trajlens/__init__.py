"""Spark-native analytics over agent trajectory logs."""
