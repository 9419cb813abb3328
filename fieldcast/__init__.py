"""Batch jobs for gridded agronomic data and harvest records, on Spark DataFrames."""
