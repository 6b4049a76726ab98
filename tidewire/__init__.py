"""News and document intelligence operators for Spark DataFrames."""
