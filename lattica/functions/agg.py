"""Aggregators: one aggregate expression each, over (value, position)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.functions import dtypes as dt
from lattica.functions import semantics as sem
from lattica.functions.dtypes import BOOL, FP32, FP64, INT64, DataType
from lattica.functions.ops import MONOIDS, _float_of


@dataclass(frozen=True)
class Aggregator:
    """fn(v, at, type) -> Column; at: the position along the reduced axis (or the (i, j) struct)."""

    name: str
    fn: Callable
    outer: Callable
    types: str = "biuf"
    position: bool = False
    finalize: Callable | None = None

    def result(self, t: DataType) -> DataType:
        return self.outer(t)

    def reduce(self, v: Column, t: DataType, at: Column) -> Column:
        if t.kind not in self.types:
            raise TypeError(f"{self.name} has no {t}")
        return self.fn(v, at, t).cast(self.outer(t).spark)

    def __call__(self, x, *, rowwise=False, columnwise=False, scalar=False):
        from lattica.operators.collection import Matrix

        if isinstance(x, Matrix):
            if rowwise:
                return x.reduce_rowwise(self)
            return x.reduce_columnwise(self) if columnwise else x.reduce_scalar(self)
        return x.reduce(self)

    def __repr__(self) -> str:
        return f"agg.{self.name}"


AGG: dict[str, Aggregator] = {}
_same = lambda t: t
_num = lambda v, t: v.cast("double") if t.kind != "b" else v.cast("int").cast("double")
_flt = lambda t: t if t.kind == "f" else FP64


def _a(name, fn, outer=_same, **o):
    AGG[name] = Aggregator(name, fn, outer, **o)


def custom(name: str, fn: Callable, outer=None) -> Aggregator:
    """fn: Column -> aggregate Column, such as a composition of built-in aggregates."""
    a = Aggregator(name, lambda v, at, t: fn(v), _same if outer is None else lambda t: dt.lookup(outer))
    return AGG.setdefault(name, a)


for _n, _mn in {"sum": "plus", "prod": "times", "any": "lor", "all": "land", "min": "min", "max": "max", "any_value": "any", "bitwise_all": "band", "bitwise_any": "bor"}.items():
    m = MONOIDS[_mn]
    _a(_n, lambda v, at, t, m=m: m.reduce(v, t), (lambda t: BOOL) if _n in ("any", "all") else _same, types=m.types)
AGG["any"] = Aggregator("any", lambda v, at, t: F.bool_or(dt.truth(v, t)), lambda t: BOOL)
AGG["all"] = Aggregator("all", lambda v, at, t: F.bool_and(dt.truth(v, t)), lambda t: BOOL)
_a("count", lambda v, at, t: F.count(F.lit(1)), lambda t: INT64, types="biufco")
_a("count_nonzero", lambda v, at, t: F.count_if(dt.truth(v, t)), lambda t: INT64)
_a("count_zero", lambda v, at, t: F.count_if(~dt.truth(v, t)), lambda t: INT64)
_a("sum_of_squares", lambda v, at, t: F.sum(dt.wide(v, t) * v), types="iuf")
_a("sum_of_inverses", lambda v, at, t: F.sum(sem.fdiv(F.lit(1.0), _num(v, t))), _flt)
_a("exists", lambda v, at, t: F.max(F.lit(1)), lambda t: INT64, types="biufco")
_a("hypot", lambda v, at, t: F.sqrt(F.sum(_num(v, t) * _num(v, t))), _flt)
_a("logaddexp", lambda v, at, t: MONOIDS["logaddexp"].agg(_num(v, t), t), _flt)
_a("logaddexp2", lambda v, at, t: MONOIDS["logaddexp2"].agg(_num(v, t), t), _flt)
_a("L0norm", AGG["count_nonzero"].fn, lambda t: INT64)
_a("L1norm", lambda v, at, t: F.sum(F.abs(dt.wide(v, t))), types="iuf")
_a("L2norm", AGG["hypot"].fn, _flt)
_a("Linfnorm", lambda v, at, t: F.max(F.abs(v)), types="iuf")
_a("mean", lambda v, at, t: F.sum(_num(v, t)) / F.count(F.lit(1)), _flt)
_a("peak_to_peak", lambda v, at, t: F.max(v) - F.min(v), types="iuf")
_a("varp", lambda v, at, t: F.var_pop(_num(v, t)), _flt)
_a("vars", lambda v, at, t: F.coalesce(F.var_samp(_num(v, t)), sem.nan()), _flt)
_a("stdp", lambda v, at, t: F.stddev_pop(_num(v, t)), _flt)
_a("stds", lambda v, at, t: F.coalesce(F.stddev_samp(_num(v, t)), sem.nan()), _flt)
_a("geometric_mean", lambda v, at, t: F.pow(F.product(_num(v, t)), 1.0 / F.count(F.lit(1))), _flt)
_a("harmonic_mean", lambda v, at, t: sem.fdiv(F.count(F.lit(1)).cast("double"), F.sum(sem.fdiv(F.lit(1.0), _num(v, t)))), _flt)
_a("root_mean_square", lambda v, at, t: F.sqrt(F.sum(_num(v, t) * _num(v, t)) / F.count(F.lit(1))), _flt)
AGG["argmin"] = Aggregator("argmin", lambda v, at, t: F.min(F.struct(v.alias("v"), at.alias("at")))["at"], lambda t: INT64, position=True)
#: The value's own order reversed without negating it: the largest value, then the least place that has it.
AGG["argmax"] = Aggregator("argmax", lambda v, at, t: -F.max(F.struct(v.alias("v"), (-at).alias("at")))["at"], lambda t: INT64, position=True)
_a("first", lambda v, at, t: F.min_by(v, at), types="biufco", position=True)
_a("last", lambda v, at, t: F.max_by(v, at), types="biufco", position=True)
_a("first_index", lambda v, at, t: F.min(at), lambda t: INT64, types="biufco", position=True)
_a("last_index", lambda v, at, t: F.max(at), lambda t: INT64, types="biufco", position=True)


def as_agg(x):
    """An aggregator or None."""
    if isinstance(x, Aggregator):
        return x
    return AGG.get(x.removeprefix("agg.").removeprefix("ss.")) if isinstance(x, str) else None
