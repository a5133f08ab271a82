"""quantloom: panel time-series analytics on PySpark DataFrames."""
