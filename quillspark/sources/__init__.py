"""Feature frames from DataFrames and Parquet."""
