"""Spark-native retrieval, verification and corpus-maintenance engine."""

__version__ = "0.1.0"
