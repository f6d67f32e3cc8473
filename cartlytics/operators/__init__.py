"""Distributed operators: DataFrames + parameters in, lazy DataFrame out."""
