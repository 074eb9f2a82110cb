"""Pure functions from log DataFrames to DataFrames."""
