"""Spark-native engine that turns document collections into a governed knowledge graph."""

__version__ = "0.1.0"
