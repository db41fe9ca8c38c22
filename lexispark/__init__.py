"""lexispark: full-text index construction and bulk text queries on Spark DataFrames."""
