"""Foliospark: documents to clean, token-bounded chunks and corpus tables, on Spark DataFrames."""

__version__ = "0.1.0"
