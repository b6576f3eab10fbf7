"""Analytics over layered, frame-based documents on Spark DataFrames."""

__version__ = "0.1.0"
