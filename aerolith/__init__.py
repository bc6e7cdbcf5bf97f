"""Spark-native analytics over air-traffic geodata."""

__version__ = "0.1.0"
