"""Ranked catalogue search and analytics expressed as Spark DataFrames."""
