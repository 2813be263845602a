"""quarry: document retrieval and training-data analytics on PySpark DataFrames."""
