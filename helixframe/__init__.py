"""Sequence indexing and search as Spark DataFrame plans."""

__version__ = "0.1.0"
