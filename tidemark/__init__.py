"""Point-in-time market-data analytics on Spark DataFrames."""
