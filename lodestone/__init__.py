"""lodestone: hybrid retrieval analytics on Spark DataFrames."""
