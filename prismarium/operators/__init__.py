"""Prismarium operators."""
