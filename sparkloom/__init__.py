"""Spark-native graph, similarity, linear-algebra and sorting analytics."""
