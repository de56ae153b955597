"""meshlore: typed graph memory, hybrid retrieval and corpus operators on Spark DataFrames."""
