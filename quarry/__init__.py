"""Exact k-means clustering and its analytics as PySpark plans."""
