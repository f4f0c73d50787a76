"""A measurement analytics engine on Spark DataFrames."""
