"""Quillon: deterministic vector and keyword search over Spark DataFrames."""
