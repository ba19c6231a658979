"""Timeline, record and training-data analytics on PySpark DataFrames."""
