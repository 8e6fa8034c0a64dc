"""A PySpark-native engine for the batch data work around agent post-training."""

__version__ = "0.1.0"
