"""Tessella: a PySpark-native engine for text and vector analytics."""
