"""Catalogue and sourcing analytics on Spark DataFrames."""
