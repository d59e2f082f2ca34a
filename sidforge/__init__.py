"""Spark-native toolkit for building and adapting semantic item identifiers."""

__version__ = "0.1.0"
