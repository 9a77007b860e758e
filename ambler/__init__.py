"""Graph sampling and data processing on Spark DataFrames."""
