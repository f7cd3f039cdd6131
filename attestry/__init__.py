"""Name-register and survey analytics on Spark DataFrames."""
