"""Spark-native analytics over multi-broker portfolio records."""
