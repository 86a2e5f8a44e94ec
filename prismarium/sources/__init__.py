"""Prismarium sources."""
