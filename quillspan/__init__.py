"""Spark-first semantic retrieval: one query language, one lazy DataFrame."""

__version__ = "0.1.0"
