"""Spark-native analytics for library catalogues, web indexes and conversation logs."""

__version__ = "0.1.0"
