"""Corpus preparation and hybrid retrieval on Spark DataFrames."""
