"""Batch hybrid ranking and corpus processing on Spark DataFrames."""
