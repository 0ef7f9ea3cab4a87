"""Sigloom: a Spark-native engine for measurement matrices keyed by short symbol sequences."""

__version__ = "0.1.0"
