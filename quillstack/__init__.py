"""Spark-native document corpus and retrieval engine."""

__version__ = "0.1.0"
