"""Operators from DataFrames to DataFrames; every one keeps samples apart by a `sample` column."""
