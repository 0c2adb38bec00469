"""Property-graph analytics over Spark DataFrames."""
