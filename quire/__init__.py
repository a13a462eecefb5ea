"""Spark-native document processing: blocks, chunks, and an incremental content-addressed index."""

__version__ = "0.1.0"
