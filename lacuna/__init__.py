"""Coverage-gap analytics on Spark DataFrames."""
