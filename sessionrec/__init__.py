"""Session recommendation on Spark DataFrames."""
