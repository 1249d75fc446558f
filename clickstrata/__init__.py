"""User-behaviour analytics on Spark DataFrames."""
