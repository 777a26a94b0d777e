"""Operators on DataFrames, by family."""
