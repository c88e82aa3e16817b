"""Procedure analytics on Spark DataFrames."""
