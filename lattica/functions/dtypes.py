"""Element types, their Spark columns, unification and C-like casts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class DataType:
    """kind: b(ool), i(nt), u(int), f(loat), c(omplex) or o(ther: structs and arrays)."""

    name: str
    spark: T.DataType
    kind: str
    bits: int = 0

    def __repr__(self) -> str:
        return self.name

    def __lt__(self, other: DataType) -> bool:
        return _ORDER.get(self.name, 99) < _ORDER.get(lookup(other).name, 99)


_C = lambda t: T.StructType([T.StructField("re", t), T.StructField("im", t)])
BOOL = DataType("BOOL", T.BooleanType(), "b", 1)
INT8, INT16 = DataType("INT8", T.ByteType(), "i", 8), DataType("INT16", T.ShortType(), "i", 16)
INT32, INT64 = DataType("INT32", T.IntegerType(), "i", 32), DataType("INT64", T.LongType(), "i", 64)
UINT8, UINT16 = DataType("UINT8", T.ShortType(), "u", 8), DataType("UINT16", T.IntegerType(), "u", 16)
UINT32, UINT64 = DataType("UINT32", T.LongType(), "u", 32), DataType("UINT64", T.DecimalType(20, 0), "u", 64)
FP32, FP64 = DataType("FP32", T.FloatType(), "f", 32), DataType("FP64", T.DoubleType(), "f", 64)
FC32, FC64 = DataType("FC32", _C(T.FloatType()), "c", 64), DataType("FC64", _C(T.DoubleType()), "c", 128)
BUILTIN = [BOOL, INT8, UINT8, INT16, UINT16, INT32, UINT32, INT64, UINT64, FP32, FP64, FC32, FC64]
_ORDER = {t.name: i for i, t in enumerate(BUILTIN)}
_NUMPY = dict(zip(("bool", "int8", "uint8", "int16", "uint16", "int32", "uint32", "int64", "uint64", "float32", "float64", "complex64", "complex128"), BUILTIN, strict=True))
_REGISTRY: dict[str, DataType] = {t.name: t for t in BUILTIN}
_PYTHON = {bool: BOOL, int: INT64, float: FP64, complex: FC64}


def lookup(x) -> DataType:
    """A type from a DataType, a name, a Python or numpy type, or a Spark type."""
    if isinstance(x, DataType):
        return x
    if isinstance(x, T.DataType):
        for t in (BOOL, INT8, INT16, INT32, INT64, FP32, FP64, UINT64, FC32, FC64):
            if t.spark == x:
                return t
        if isinstance(x, T.DecimalType):
            return UINT64
        return register(x.simpleString(), x)
    if isinstance(x, type) and x in _PYTHON:
        return _PYTHON[x]
    if isinstance(x, str) and x.upper() in _REGISTRY:
        return _REGISTRY[x.upper()]
    if isinstance(x, str) and x in _REGISTRY:
        return _REGISTRY[x]
    if isinstance(x, dict):
        return register("{" + ", ".join(f"{k}: {lookup(v)}" for k, v in x.items()) + "}", T.StructType([T.StructField(k, lookup(v).spark) for k, v in x.items()]))
    if isinstance(x, str) and "[" in x:  # fixed arrays, such as "INT64[3]"
        return register(x, T.ArrayType(lookup(x.split("[")[0]).spark))
    try:
        d = np.dtype(x)
    except TypeError:
        raise TypeError(f"no such type: {x!r}") from None
    if d.names:
        return lookup({n: d.fields[n][0] for n in d.names})
    if d.subdtype:
        return register(f"{lookup(d.subdtype[0])}{list(d.subdtype[1])}", T.ArrayType(lookup(d.subdtype[0]).spark))
    if d.name not in _NUMPY:
        raise TypeError(f"no such type: {x!r}")
    return _NUMPY[d.name]


def register(name: str, spark) -> DataType:
    """A user type over a Spark type, a dict of fields, or anything lookup takes."""
    if not isinstance(spark, T.DataType):
        spark = lookup(spark).spark
    return _REGISTRY.setdefault(name, DataType(name, spark, "o"))


def of_value(v) -> DataType:
    if isinstance(v, np.generic):
        return lookup(v.dtype)
    if isinstance(v, dict):
        return lookup({k: of_value(x) for k, x in v.items()})
    return lookup(type(v))


def numpy_of(t: DataType):
    return next((np.dtype(n) for n, x in _NUMPY.items() if x == t), np.dtype(object))


def unify(a, b, weak: bool = False) -> DataType:
    """The common type; weak: b is a scalar that bends to a where its kind allows."""
    a, b = lookup(a), lookup(b)
    if a == b:
        return a
    if "o" in (a.kind, b.kind):
        raise TypeError(f"no common type of {a} and {b}")
    rank = "biufc".replace("iu", "i").index
    k = lambda t: rank("i" if t.kind == "u" else t.kind)
    if weak and k(b) <= k(a):
        return a
    return lookup(np.promote_types(numpy_of(a), numpy_of(b)))


def _two64() -> Column:
    return F.lit(str(1 << 64)).cast("decimal(38,0)")


def signed(c: Column) -> Column:
    """A UINT64 column's bits as a signed 64-bit integer."""
    d = c.cast("decimal(38,0)")
    return F.when(d > (1 << 63) - 1, d - _two64()).otherwise(d).cast("long")


def unsigned(c: Column) -> Column:
    """The reverse of signed."""
    d = c.cast("decimal(38,0)")
    return F.when(d < 0, d + _two64()).otherwise(d).cast(UINT64.spark)


def wide(c: Column, t: DataType) -> Column:
    """The column in which integer arithmetic of t is done."""
    return c.cast("decimal(38,0)") if t == UINT64 else c.cast("long") if t.kind in "iu" else c


def wrap(c: Column, t: DataType) -> Column:
    """Integer results modulo 2^bits, as C's. INT64 is left to Spark, which raises on overflow."""
    if t.kind == "i" and t.bits < 64:
        s = 64 - t.bits
        return F.call_function("shiftright", F.call_function("shiftleft", c.cast("long"), F.lit(s)), F.lit(s)).cast(t.spark)
    if t == UINT64:
        return F.pmod(c.cast("decimal(38,0)"), _two64()).cast(t.spark)
    if t.kind == "u":
        return c.cast("long").bitwiseAND(F.lit((1 << t.bits) - 1)).cast(t.spark)
    return c.cast(t.spark)


def truth(c: Column, t: DataType) -> Column:
    return c if t.kind == "b" else c != F.lit(0).cast(t.spark)


def cast(c: Column, src: DataType, dst: DataType) -> Column:
    """C's conversion: to BOOL by truth, floats to integers toward 0 with NaN to 0."""
    if src == dst:
        return c
    if "o" in (src.kind, dst.kind):
        raise TypeError(f"{src} does not cast to {dst}")
    if dst.kind == "c":
        part = dst.spark["re"].dataType
        if src.kind == "c":
            return F.struct(c["re"].cast(part).alias("re"), c["im"].cast(part).alias("im"))
        return F.struct(cast(c, src, FP64).cast(part).alias("re"), F.lit(0.0).cast(part).alias("im"))
    if src.kind == "c":
        return cast(c["re"], FP64 if src == FC64 else FP32, dst)
    if dst.kind == "b":
        return truth(c, src)
    if src.kind == "b":
        return c.cast("int").cast(dst.spark)
    if src.kind == "f" and dst.kind in "iu":
        lim = 2.0**64 if dst == UINT64 else 2.0**63
        safe = F.when(F.isnan(c), 0.0).when(c >= lim, F.lit(lim if dst == UINT64 else 9223372036854774784.0)).when(c <= -lim, -lim).otherwise(c.cast("double"))
        return wrap(safe.cast("decimal(38,0)") if dst == UINT64 else safe.cast("long"), dst)
    if dst.kind in "iu":
        if src == UINT64:
            return wrap(signed(c), dst)
        return unsigned(c.cast("long")) if dst == UINT64 else wrap(c.cast("long"), dst)
    return c.cast(dst.spark)


def lit(v, t: DataType) -> Column:
    """A constant of type t."""
    if t.kind == "c":
        v = complex(v)
        part = t.spark["re"].dataType
        return F.struct(F.lit(v.real).cast(part).alias("re"), F.lit(v.imag).cast(part).alias("im"))
    if t.kind == "o":
        if isinstance(v, dict):
            return F.struct(*(F.lit(v[f.name]).cast(f.dataType).alias(f.name) for f in t.spark.fields))
        if isinstance(t.spark, T.ArrayType):
            return F.array(*(F.lit(x).cast(t.spark.elementType) for x in np.ravel(v).tolist()))
        return F.struct(*(F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(tuple(v), t.spark.fields, strict=True)))
    if isinstance(v, np.generic):
        v = v.item()
    if t.kind == "b":
        return F.lit(bool(v))
    if t.kind == "f":
        return F.lit(float(v)).cast(t.spark)
    v = int(v)
    lo = 0 if t.kind == "u" else -(1 << (t.bits - 1))
    v = (v - lo) % (1 << t.bits) + lo
    return F.lit(str(v)).cast(t.spark) if t == UINT64 else F.lit(v).cast(t.spark)
