"""Spark-native analytics over graphs that change over time."""

__version__ = "0.1.0"
