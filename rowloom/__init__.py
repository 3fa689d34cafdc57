"""Spark-native table generation, degradation and data-quality operators."""

__version__ = "0.1.0"
