"""Offline ranking evaluation and experiment analytics on Spark DataFrames."""
