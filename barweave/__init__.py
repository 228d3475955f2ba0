"""Spark-native analytics over daily price bars."""
