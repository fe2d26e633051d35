"""Skriva: a PySpark-native full-text search and ranking engine."""

__version__ = "0.1.0"
