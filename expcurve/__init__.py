"""Spark-native technology-learning analytics over energy-model output."""

__version__ = "0.1.0"
