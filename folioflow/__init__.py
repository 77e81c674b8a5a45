"""folioflow: a PySpark-native engine for multi-page document collections."""

__version__ = "0.1.0"
