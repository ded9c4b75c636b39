"""Kestrata: ordered keyed tables, updates and text search on Spark DataFrames."""
