"""Spark-native analytics for irregular fuel-station price events."""

__version__ = "0.1.0"
