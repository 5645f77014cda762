"""Departure-time path-profile analytics on Spark DataFrames."""
