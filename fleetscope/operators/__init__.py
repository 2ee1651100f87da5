"""Batch operators: DataFrames in, DataFrame out, nothing is collected on the driver."""
