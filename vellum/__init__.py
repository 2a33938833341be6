"""Document-structure analytics on Spark DataFrames."""
