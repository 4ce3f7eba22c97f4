"""Mesh-contact analytics over Spark DataFrames."""
