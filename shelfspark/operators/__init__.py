"""Catalog operators: each is a function of DataFrames to a DataFrame or Column, without actions inside."""
