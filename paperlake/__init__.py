"""paperlake: bibliographic-record operators for PySpark DataFrames."""
