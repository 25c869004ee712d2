"""verbatlas: a PySpark-native corpus search and text-analytics engine."""

__version__ = "0.1.0"
