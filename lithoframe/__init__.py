"""Document-evidence analytics on PySpark DataFrames."""
