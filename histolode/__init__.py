"""Spark-native analytics over software-repository history."""
