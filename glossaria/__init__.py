"""Vocabulary and metadata analytics on Spark DataFrames."""
