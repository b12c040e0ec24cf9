"""Search, index, collection, filter and evaluation operators on DataFrames."""
