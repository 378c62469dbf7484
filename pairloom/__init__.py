"""Contact-map analytics on Spark DataFrames."""
