"""Masks: sets of coordinates, structural or by truth of the value, and complements."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import dtypes as dt


@dataclass(frozen=True)
class Mask:
    parent: object
    value: bool  # by value, else by structure
    complement: bool = False

    def __invert__(self) -> Mask:
        return Mask(self.parent, self.value, not self.complement)

    @property
    def keys(self) -> list[str]:
        return self.parent.KEYS

    @property
    def shape(self) -> tuple:
        return self.parent.shape

    def coords(self) -> DataFrame:
        """The coordinates of the mask before complement."""
        df = self.parent.df
        if self.value:
            df = df.where(dt.truth(F.col("v"), self.parent.dtype))
        return df.select(*self.keys)

    def keep(self, df: DataFrame) -> DataFrame:
        """The rows of df inside the mask: a semi or anti join."""
        return df.join(self.coords(), self.keys, "left_anti" if self.complement else "left_semi")

    def _both(self, other: Mask, how: str) -> Mask:
        """Intersection and union without densifying: complements stay symbolic."""
        a, b, k = self.coords(), other.coords(), self.keys
        if how == "or":  # not(not a and not b)
            return ~((~self)._both(~other, "and"))
        if self.complement and other.complement:
            out, comp = a.union(b).distinct(), True
        elif self.complement:
            out, comp = b.join(a, k, "left_anti"), False
        elif other.complement:
            out, comp = a.join(b, k, "left_anti"), False
        else:
            out, comp = a.join(b, k, "left_semi"), False
        own = type(self.parent).of(out.withColumn("v", F.lit(True)), dt.BOOL, self.shape)
        return Mask(own, False, comp)

    def __and__(self, other: Mask) -> Mask:
        return self._both(other, "and")

    def __or__(self, other: Mask) -> Mask:
        return self._both(other, "or")

    def new(self, dtype=None, *, complement: bool = False, mask: Mask | None = None):
        """A BOOL collection of true at the mask's coordinates."""
        use = ~self if complement else self
        if mask is not None:
            use = use & mask
        if not use.complement:
            df = use.coords().withColumn("v", F.lit(True))
        else:
            df = use.parent.dense_coords().join(use.coords(), use.keys, "left_anti").withColumn("v", F.lit(True))
        out = type(self.parent).of(df, dt.BOOL, self.shape)
        return out if dtype is None else out.dup(dtype)


def check(mask) -> Mask | None:
    """A bare BOOL collection counts by value."""
    if mask is None or isinstance(mask, Mask):
        return mask
    if getattr(mask, "dtype", None) is not None and mask.dtype.kind == "b":
        return Mask(mask, True)
    raise TypeError("a mask is A.S, A.V, their complements, or a BOOL collection")
