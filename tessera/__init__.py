"""Spark-native analytics over typed, evidence-carrying property graphs and their texts."""
