"""Point-cloud intensity equalization on Spark DataFrames."""

__version__ = "0.1.0"
