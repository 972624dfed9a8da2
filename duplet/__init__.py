"""Near-duplicate analytics on Spark DataFrames."""
