"""gridspan: array analytics on Spark DataFrames."""
