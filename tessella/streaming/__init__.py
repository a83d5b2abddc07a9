"""Tessella streaming."""
