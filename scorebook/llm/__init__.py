"""Training-data operators on Spark DataFrames; nothing outside this subpackage imports it."""
