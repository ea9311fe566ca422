"""Spark-native analysis of libraries of citable sources and their texts."""
