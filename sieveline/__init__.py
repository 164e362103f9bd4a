"""Evidence retrieval, selection, routing and audit operators on Spark DataFrames."""
