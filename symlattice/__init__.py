"""Code-graph analytics and corpus operations on Spark DataFrames."""
