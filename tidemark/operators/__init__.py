"""Relational operators of the log: plain functions from DataFrames to DataFrames."""
