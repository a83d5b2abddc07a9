"""Tessella plans."""
