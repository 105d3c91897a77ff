"""Spark-native ranking of individual entities from group-shaped competition records."""

__version__ = "0.1.0"
