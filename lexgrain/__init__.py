"""lexgrain: retrieval, citation analytics and corpus processing on Spark DataFrames."""
