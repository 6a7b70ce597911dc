"""The analytical methods, as functions from DataFrames to DataFrames."""
