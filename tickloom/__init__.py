"""Technical-analysis operators over Spark DataFrames."""
