"""Longitudinal text analytics on Spark DataFrames."""
