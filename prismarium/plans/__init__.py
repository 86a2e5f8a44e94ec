"""Prismarium plans."""
