"""gridloom: time-aligned feature analytics on Spark DataFrames."""
