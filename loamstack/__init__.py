"""Evidence retrieval and text-collection maintenance on Spark DataFrames."""
