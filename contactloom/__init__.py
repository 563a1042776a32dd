"""Spark-native analytics for chromosome-contact data."""

__version__ = "0.1.0"
