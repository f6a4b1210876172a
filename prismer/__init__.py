"""Colored k-mer analytics on Spark DataFrames."""
