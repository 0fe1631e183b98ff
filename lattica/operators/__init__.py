"""Sparse collections over coordinate DataFrames and the operations on them."""
