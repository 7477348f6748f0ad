"""cartwright: product analytics over view / cart / purchase events, on Spark DataFrames."""

__version__ = "0.1.0"
