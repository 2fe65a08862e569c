"""Relational operators as functions from DataFrames to DataFrames, independent of any schema."""
