"""Vector search and document embedding on Spark DataFrames."""
