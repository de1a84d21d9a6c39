"""Track, flow and sensor analytics as plain functions on Spark DataFrames."""

__version__ = "0.1.0"
