"""Spark-native analytics for irregularly sampled sensor and positioning logs."""

__version__ = "0.1.0"
