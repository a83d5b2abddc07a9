"""Tessella functions."""
