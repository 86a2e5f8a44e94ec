"""Prismarium streaming."""
