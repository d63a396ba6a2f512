"""Vector, hybrid and scalar queries over collections of records, on Spark DataFrames."""
