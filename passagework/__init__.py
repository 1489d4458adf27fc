"""Permission-aware retrieval, verified answering and data processing on Spark DataFrames."""

__version__ = "0.1.0"
