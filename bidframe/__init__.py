"""Spark-native operators for bid pricing and procurement text."""
