"""Tessella operators."""
