"""Editorial and market-data analytics on Spark DataFrames."""
