"""Logical plans of questions, and their way into DataFrames."""
