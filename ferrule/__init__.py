"""Document-retrieval analytics on PySpark DataFrames."""
