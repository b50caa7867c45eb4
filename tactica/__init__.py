"""Spark jobs for position features, tagging and evaluation (see README.md)."""
