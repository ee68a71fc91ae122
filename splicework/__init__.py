"""Exact timeline and media analytics, written as Spark DataFrames."""
