"""Operators of the knowledge store, each a function from DataFrames to a DataFrame."""
