"""Spark-native cleaning, classification, resolution and linking of asset records."""

__version__ = "0.1.0"
