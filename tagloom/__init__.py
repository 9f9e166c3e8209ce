"""tagloom: tagged-text analytics on PySpark DataFrames."""
