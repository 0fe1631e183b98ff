"""Sparse matrices, vectors and graph analytics on Spark DataFrames."""

from lattica import exceptions
from lattica.functions import dtypes
from lattica.operators.collection import Matrix, Scalar, Vector
from lattica.operators.expr import agg, binary, indexbinary, indexunary, monoid, op, select, semiring, unary

__all__ = ["Matrix", "Scalar", "Vector", "agg", "binary", "dtypes", "exceptions", "indexbinary", "indexunary", "monoid", "op", "select", "semiring", "unary"]
