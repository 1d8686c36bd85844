"""Content-graph analytics on Spark DataFrames."""
