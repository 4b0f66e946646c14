"""Spark-native analytics for conversational memory: search, graph traversal, weight dynamics, sessions and statistics."""
