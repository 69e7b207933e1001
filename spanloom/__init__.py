"""Spark-first alignment of target phrases inside source texts."""

__version__ = "0.1.0"
