"""Comparative-genomics table engine on Spark DataFrames."""
