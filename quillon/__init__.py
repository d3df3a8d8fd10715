"""Distance-based pattern classification on PySpark DataFrames."""
