"""lumenloom: evidence analytics on PySpark DataFrames."""
