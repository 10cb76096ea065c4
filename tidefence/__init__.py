"""Spatiotemporal event analytics on Spark DataFrames."""
