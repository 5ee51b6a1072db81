"""Spark-native preparation of well-log and seismic data."""

__version__ = "0.1.0"
