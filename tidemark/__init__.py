"""Time-series signal analytics on Spark DataFrames."""
