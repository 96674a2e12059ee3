"""Column intelligence for Spark DataFrames: detect, profile, classify and stabilise columns."""

__version__ = "0.1.0"
