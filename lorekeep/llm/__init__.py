"""Operators for large-scale training-data pipelines, built on DataFrames."""
