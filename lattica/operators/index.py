"""Index lists and slices as predicates and small relations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.exceptions import IndexOutOfBound


#: Index lists up to this length are broadcast; longer ones are joined as tables.
BROADCAST = 1 << 20


def _sized(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST else df


class Index:
    """One axis: ``all``, ``int``, ``range`` (start, step, n) or ``list``."""

    def __init__(self, x, size: int):
        self.size, self.values = size, None
        if hasattr(x, "value") and not isinstance(x, slice):
            x = x.value
        if isinstance(x, bool | float | str) or hasattr(x, "KEYS"):
            raise TypeError(f"invalid index: {x!r}")
        if isinstance(x, int | np.integer):
            i = int(x)
            if not -size <= i < size:
                raise IndexOutOfBound(f"index {i} of {size}")
            self.kind, self.start, self.step, self.n = "int", i % size if i < 0 else i, 1, 1
        elif x is None or x is Ellipsis or (isinstance(x, slice) and x == slice(None)):
            self.kind, self.start, self.step, self.n = "all", 0, 1, size
        elif isinstance(x, slice | range):
            r = range(*x.indices(size)) if isinstance(x, slice) else x
            self.kind, self.start, self.step, self.n = "range", r.start, r.step, len(r)
        else:
            v = np.asarray(x)
            if v.dtype.kind == "b" or (v.size and v.dtype.kind not in "iu") or v.ndim != 1:
                raise TypeError(f"invalid index: {x!r}")
            if v.size and (v.min() < -size or v.max() >= size):
                raise IndexOutOfBound(f"index out of {size}")
            self.values = [int(i) % size if i < 0 else int(i) for i in v]
            self.kind, self.n = "list", len(self.values)

    @property
    def is_int(self) -> bool:
        return self.kind == "int"

    def place(self, df: DataFrame, key: str) -> DataFrame:
        """df's rows at these indices, key renumbered from 0 (dropped for an int)."""
        c = F.col(key)
        if self.kind == "int":
            return df.where(c == self.start).drop(key)
        if self.kind == "all":
            return df
        if self.kind == "range":
            return df.where(self.inside(c)).withColumn(key, F.call_function("div", c - self.start, F.lit(self.step)))
        old = df.sparkSession.createDataFrame(list(zip(self.values, range(self.n), strict=True)), f"{key} long, new long")
        return df.join(_sized(old, self.n), key).withColumn(key, F.col("new")).drop("new")

    def unplace(self, c: Column) -> Column:
        """The index of place c (ranges and ints)."""
        return c * self.step + self.start

    def restore(self, df: DataFrame, key: str) -> DataFrame:
        """The reverse of place: renumbers 0.. to the indices; of repeated indices the last wins."""
        if self.kind == "int":
            return df.withColumn(key, F.lit(self.start).cast("long"))
        if self.kind in ("all", "range"):
            return df.withColumn(key, self.unplace(F.col(key)))
        last = {v: i for i, v in enumerate(self.values)}
        new = df.sparkSession.createDataFrame([(i, v) for v, i in last.items()] or [(-1, -1)], f"{key} long, new long")
        return df.join(_sized(new, self.n), key).withColumn(key, F.col("new")).drop("new")

    def inside(self, c: Column) -> Column:
        """c is one of the indices: a predicate that is pushed to the scan."""
        if self.kind == "all":
            return F.lit(True)
        if self.kind == "int":
            return c == self.start
        if self.kind == "range":
            if not self.n:
                return F.lit(False)
            lo, hi = sorted((self.start, self.start + self.step * (self.n - 1)))
            near = c.between(lo, hi)
            return near if abs(self.step) == 1 else near & ((c - lo) % abs(self.step) == 0)
        return c.isin(sorted(set(self.values))) if self.values else F.lit(False)  # a predicate: the list is in the plan

    def listed(self, spark, key: str) -> DataFrame:
        """All indices as rows."""
        if self.kind == "list":
            return spark.createDataFrame([(v,) for v in sorted(set(self.values))] or [], f"{key} long")
        lo, hi = (0, 0) if not self.n else sorted((self.start, self.start + self.step * (self.n - 1)))
        return spark.range(lo, hi + 1 if self.n else lo, abs(self.step)).toDF(key)
