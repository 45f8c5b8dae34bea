"""quarry: batch evidence jobs on Spark DataFrames."""
