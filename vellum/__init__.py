"""A PySpark-native engine for document analytics."""

__version__ = "0.1.0"
