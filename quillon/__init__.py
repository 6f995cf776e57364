"""A panel analytics engine on Spark DataFrames."""
