"""Document-index analytics and training-data preparation on Spark DataFrames."""
