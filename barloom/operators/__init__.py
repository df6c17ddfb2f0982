"""Operators: they take DataFrames and return DataFrames."""
