"""Tessella: a PySpark-native engine for columnar files and the rows in them."""

__version__ = "0.1.0"
