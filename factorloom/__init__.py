"""Low-rank factorization of large sparse ratings with Spark DataFrames."""
