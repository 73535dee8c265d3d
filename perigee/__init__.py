"""Spark-native harmonic analysis of very many time series."""

__version__ = "0.1.0"
