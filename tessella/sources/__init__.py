"""Tessella sources."""
