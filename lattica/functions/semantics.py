"""C and numpy value semantics as column expressions, alike in ANSI and non-ANSI sessions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

inf, nan = (lambda: F.lit(math.inf)), (lambda: F.lit(math.nan))


def fdiv(x: Column, y: Column) -> Column:
    """x / y with 0/0 = nan and x/0 = +-inf."""
    by0 = F.when((x == 0) | F.isnan(x), nan()).otherwise(F.when((x > 0) == ~minus_zero(y), inf()).otherwise(-inf()))
    return F.when(y == 0, by0).otherwise(x / F.when(y == 0, F.lit(1.0)).otherwise(y))


def minus_zero(y: Column) -> Column:
    """y is -0.0 (for y equal to 0)."""
    return F.coalesce(F.atan2(y.cast("double"), F.lit(-1.0)) < 0, F.lit(False))


def nonzero(y: Column) -> Column:
    return F.when(y == 0, F.raise_error(F.lit("ZeroDivisionError"))).otherwise(y)


def idiv(x: Column, y: Column) -> Column:
    """Integer division toward 0."""
    return F.call_function("div", x, nonzero(y))


def mod(x: Column, y: Column) -> Column:
    """Sign of the divisor, as numpy.mod."""
    m = x % nonzero(y)
    return F.when((m != 0) & ((m < 0) != (y < 0)), m + y).otherwise(m)


def fmod_floor(x: Column, y: Column) -> Column:
    """numpy.mod of floats; nan for a divisor of 0."""
    safe = F.when(y == 0, F.lit(1.0)).otherwise(y)
    m = x % safe
    m = F.when((m != 0) & ((m < 0) != (y < 0)), m + y).otherwise(m)
    return F.when(y == 0, nan()).otherwise(m)


def floordiv(x: Column, y: Column) -> Column:
    return F.call_function("div", x - mod(x, y), nonzero(y))


def eq(x: Column, y: Column, floats: bool) -> Column:
    return (x == y) & ~F.isnan(x) & ~F.isnan(y) if floats else x == y


def compare(name: str, x: Column, y: Column, floats: bool) -> Column:
    """IEEE comparisons: false with NaN, but for ne."""
    if name == "ne":
        return ~eq(x, y, floats)
    if name == "eq":
        return eq(x, y, floats)
    out = {"lt": x < y, "gt": x > y, "le": x <= y, "ge": x >= y}[name]
    return out & ~F.isnan(x) & ~F.isnan(y) if floats else out


def fmin(x: Column, y: Column) -> Column:
    return F.when(F.isnan(x), y).when(F.isnan(y), x).otherwise(F.least(x, y))


def fmax(x: Column, y: Column) -> Column:
    return F.when(F.isnan(x), y).when(F.isnan(y), x).otherwise(F.greatest(x, y))


def nan_to_null(v: Column) -> Column:
    return F.when(~F.isnan(v), v)


def log(x: Column, fn) -> Column:
    """Logarithms with log(0) = -inf and nan below."""
    return F.when(x == 0, -inf()).when(x < 0, nan()).when(F.isnan(x), nan()).otherwise(fn(F.when(x > 0, x)))


def whole(x: Column, fn) -> Column:
    """ceil, floor and the like, which stay floats; values without a fraction pass."""
    big = F.isnan(x) | (F.abs(x) >= 2.0**52)
    return F.when(big, x).otherwise(fn(F.when(big, F.lit(0.0)).otherwise(x)).cast("double"))


def ipow(x: Column, y: Column) -> Column:
    """Integer power through DOUBLE, exact below 2^53."""
    return F.pow(x.cast("double"), y.cast("double"))
