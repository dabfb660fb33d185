"""Distributed audio analytics on Spark: recordings are rows, signals are arrays."""

__version__ = "0.1.0"
