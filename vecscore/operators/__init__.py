"""Operators: each is a function on DataFrames; wrappers with paths follow the project layout."""
