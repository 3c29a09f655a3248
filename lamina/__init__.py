"""Spark-native analytics for layered video streams: sources, operators, plans and streaming over DataFrames."""

__version__ = "0.1.0"
