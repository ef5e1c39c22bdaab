"""Fleet routing analytics on Spark DataFrames."""
