"""Skein: hybrid retrieval and corpus analytics on Spark DataFrames."""
