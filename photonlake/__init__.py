"""Photonlake: media-index analytics on Spark DataFrames."""
