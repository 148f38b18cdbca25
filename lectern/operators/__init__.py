"""Operators of document review: DataFrames in, DataFrames out."""
