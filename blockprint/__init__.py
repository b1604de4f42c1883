"""Context-triggered piecewise hashing and corpus preparation on Spark DataFrames."""
