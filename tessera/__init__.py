"""Spark-native design-fact analytics: scan sources, extract facts, query them."""

__version__ = "0.1.0"
