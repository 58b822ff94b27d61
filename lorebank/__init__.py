"""A PySpark-native engine for agent memory data and retrieval."""

__version__ = "0.1.0"
