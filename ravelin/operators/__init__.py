"""Operators: each takes DataFrames and returns lazy DataFrames."""
