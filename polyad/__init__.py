"""Sparse tuple-tensor analytics on Spark DataFrames."""
