"""Evidence, verification and retrieval over documents and questions as Spark DataFrames."""

__version__ = "0.1.0"
