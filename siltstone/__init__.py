"""Siltstone: hybrid text and code retrieval on Spark DataFrames."""

__version__ = "1.0.0"
