"""Histogram-centric analytics on Spark DataFrames."""
