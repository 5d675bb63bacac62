"""Tournament and ordered-event analytics on PySpark DataFrames."""
