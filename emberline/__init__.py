"""Wildfire behaviour, spread and consequence analytics on Spark DataFrames."""
