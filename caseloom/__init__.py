"""Set-based case-work analytics on Spark: DataFrames in, DataFrames out."""
