"""Card-fraud graph analytics on Spark DataFrames."""
