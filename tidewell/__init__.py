"""Hybrid search over document collections and commit histories, on Spark DataFrames."""
