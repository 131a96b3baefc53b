"""Operators: each takes DataFrames keyed by repository and returns DataFrames."""
