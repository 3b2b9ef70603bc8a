"""Listing analytics on Spark: link, filter, enrich, rank and track postings as DataFrames."""
