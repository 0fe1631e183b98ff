"""Scalar operators: unary, binary, index-unary, index-binary, monoids, semirings.

An operator is a rule for its types and a function of columns. ``compute`` casts the
arguments to the operator's own type, applies it and casts or wraps the result, so
everything stays in whole-stage code generation. Operators that Spark has no
expression for (erf, gamma, gcd, ...) are Arrow-batched pandas UDFs.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.exceptions import UdfParseError
from lattica.functions import dtypes as dt
from lattica.functions import semantics as sem
from lattica.functions.dtypes import BOOL, FC32, FC64, FP32, FP64, INT64, DataType


def _float_of(t: DataType) -> DataType:
    """Small integers compute in FP32, others in FP64, as C's math functions are typed."""
    if t.kind in "fc":
        return t
    return FP32 if t.bits <= 16 else FP64


@dataclass(frozen=True)
class Op:
    name: str
    fn: Callable
    types: str = "biuf"  # kinds of input
    inner: Callable = lambda t: t  # type to compute in, from the input's
    outer: Callable = lambda t: t  # type of the result, from the computing type
    positional: bool = False
    meta: dict = field(default_factory=dict, hash=False, compare=False)
    pinned: DataType | None = None

    def __getitem__(self, t) -> Op:
        """The operator for one type."""
        t = dt.lookup(t)
        if not self.positional and t.kind not in self.types:
            raise KeyError(f"{self.name} has no {t}")
        return replace(self, pinned=t)

    def __contains__(self, t) -> bool:
        return self.positional or dt.lookup(t).kind in self.types

    @property
    def types_table(self) -> dict:
        return {t: self.result(t) for t in dt.BUILTIN if t in self}

    def computing(self, t: DataType) -> DataType:
        t = self.pinned or t
        if t.kind == "o" and self.name in LIFTED:
            return t
        if t.kind not in self.types and not self.positional:
            raise TypeError(f"{self.name} has no {t}")
        return self.inner(t)

    def result(self, t: DataType) -> DataType:
        if t.kind == "o" and self.name in LIFTED and self.pinned is None:
            return t
        return INT64 if self.positional else self.outer(self.computing(t))

    def __call__(self, *args, **kwargs):
        from lattica.operators.expr import call

        return call(self, *args, **kwargs)

    def __repr__(self) -> str:
        return f"{type(self).__name__.lower()}.{self.name}"


#: Operators that go into the fields of records and the elements of arrays.
LIFTED = {"plus", "minus", "times", "truediv", "floordiv", "min", "max", "ainv", "abs"}


def _lift(op, cols: list[Column], spark) -> Column:
    """A lifted operator on user types, field by field and element by element."""
    if isinstance(spark, T.StructType):
        return F.struct(*(_lift(op, [c[f.name] for c in cols], f.dataType).alias(f.name) for f in spark.fields))
    if isinstance(spark, T.ArrayType):
        if len(cols) == 1:
            return F.transform(cols[0], lambda x: _lift(op, [x], spark.elementType))
        return F.zip_with(*cols, lambda x, y: _lift(op, [x, y], spark.elementType))
    t = dt.lookup(spark)
    return (op.compute(cols[0], t) if len(cols) == 1 else op.compute(*cols, t, t)).cast(spark)


class UnaryOp(Op):
    def compute(self, x: Column, t: DataType, i: Column | None = None, j: Column | None = None) -> Column:
        if self.positional:
            return self.fn(i, j).cast("long")
        if t.kind == "o" and self.name in LIFTED:
            return _lift(self, [x], t.spark)
        w = self.computing(t)
        return _finish(self.fn(dt.wide(dt.cast(x, t, w), w), w), self.outer(w))


class BinaryOp(Op):
    def compute(self, x: Column, y: Column, tx: DataType, ty: DataType, at: dict | None = None, unified: DataType | None = None) -> Column:
        """at: coordinate columns ix, jx, iy, jy for positional and index-binary operators."""
        if self.positional:
            return self.fn(at).cast("long")
        t = unified or unify_args(self, tx, ty)
        if t.kind == "o" and self.name in LIFTED:
            return _lift(self, [x, y], t.spark)
        w = self.computing(t)
        one = lambda c, s: dt.wide(dt.cast(c, s, w), w)
        if self.meta.get("raw"):
            return self.fn(x, y, tx, ty)
        if "theta" in self.meta:
            return _finish(self.fn(one(x, tx), at.get("ix"), at.get("jx"), one(y, ty), at.get("iy"), at.get("jy"), self.meta["theta"]), self.outer(w))
        return _finish(self.fn(one(x, tx), one(y, ty), w), self.outer(w))

    def out(self, tx: DataType, ty: DataType, unified: DataType | None = None) -> DataType:
        if self.meta.get("raw"):
            return self.meta["raw"](tx, ty)
        return self.result(unified or unify_args(self, tx, ty))

    @property
    def monoid(self):
        return MONOIDS.get(self.meta.get("monoid", self.name))

    @property
    def commutes_to(self):
        name = self.meta.get("swap", self.name if self.name in COMMUTES else None)
        return BINARY.get(name) if name else None

    @property
    def is_commutative(self) -> bool:
        return self.commutes_to is not None and self.commutes_to.name == self.name


def unify_args(op: BinaryOp, tx: DataType, ty: DataType) -> DataType:
    if op.pinned:
        return op.pinned
    if op.meta.get("side"):
        return tx if op.meta["side"] == "x" else ty
    return dt.unify(tx, ty)


def _finish(c: Column, t: DataType) -> Column:
    return dt.wrap(c, t) if t.kind in "iu" else c if t.kind in "bo" else c.cast(t.spark)


class IndexUnaryOp(Op):
    def compute(self, x: Column, t: DataType, i: Column, j: Column, thunk: Column) -> Column:
        return self.fn(x, i, j, thunk, t)

    def result(self, t: DataType) -> DataType:
        return self.meta["out"]

    @property
    def is_select(self) -> bool:
        return self.meta["out"] == BOOL


class SelectOp(IndexUnaryOp):
    pass


@dataclass(frozen=True)
class IndexBinaryOp:
    """f(x, ix, jx, y, iy, jy, theta); ``op(theta)`` or ``op[T](theta)`` is a BinaryOp."""

    name: str
    fn: Callable
    outer: Callable = lambda t: t
    pinned: DataType | None = None

    def __getitem__(self, t) -> IndexBinaryOp:
        return replace(self, pinned=dt.lookup(t))

    def __call__(self, theta=0) -> BinaryOp:
        return BinaryOp(self.name, self.fn, "biufco", outer=self.outer, meta={"theta": theta, "coords": True}, pinned=self.pinned)


# ---------------------------------------------------------------- unary

UNARY: dict[str, UnaryOp] = {}
BINARY: dict[str, BinaryOp] = {}
INDEXUNARY: dict[str, IndexUnaryOp] = {}
INDEXBINARY: dict[str, IndexBinaryOp] = {}
MONOIDS: dict[str, Monoid] = {}
AGGREGATORS: dict = {}


def _u(name: str, fn, types="biuf", inner=lambda t: t, outer=lambda t: t, **meta):
    UNARY[name] = UnaryOp(name, fn, types, inner, outer, meta=meta)


def _udf(fn, kind: str = "double"):
    """A scalar math function as an Arrow-batched UDF (its annotations are read from this module's names)."""
    @F.pandas_udf(kind)
    def run(*cols: pd.Series) -> pd.Series:
        return pd.Series([fn(*v) for v in zip(*cols, strict=True)])

    return run


def _bits(f, t: DataType, *cols: Column) -> Column:
    """f of integers' bits; UINT64 goes through its signed twin."""
    return dt.unsigned(f(*map(dt.signed, cols))) if t == dt.UINT64 else f(*cols)


def _safe(fn):
    def run(*v):
        try:
            return fn(*v)
        except (ValueError, OverflowError):
            return math.nan if any(math.isnan(x) for x in v) else math.inf

    return run


def _isc(t):
    return t.kind == "c"


def _cplx(re, im):
    return F.struct(re.alias("re"), im.alias("im"))


def _ainv(x, t):
    return x if t == BOOL else _cplx(-x["re"], -x["im"]) if _isc(t) else -x


def _minv(x, t):
    if t.kind == "f":
        return sem.fdiv(F.lit(1.0), x)
    if t.kind == "b":
        return F.lit(True)
    return F.call_function("div", F.lit(1).cast(t.spark), sem.nonzero(x))


_u("identity", lambda x, t: x, "biufco")
_u("one", lambda x, t: dt.lit(1, t), "biufc")
_u("ainv", _ainv, "biufc")
_u("minv", _minv)
_u("abs", lambda x, t: F.hypot(x["re"], x["im"]) if _isc(t) else x if t.kind in "bu" else F.abs(x), "biufc", outer=lambda t: FP64 if t == FC64 else FP32 if t == FC32 else t)
_u("lnot", lambda x, t: _as(~dt.truth(x, t), t))
_u("bnot", lambda x, t: _bits(lambda a: F.bitwise_not(a), t, x), "iu")


def _as(c: Column, t: DataType) -> Column:
    """A truth value as 0 or 1 of type t."""
    return c if t.kind == "b" else c.cast("int").cast(t.spark)


_MATH = {
    "sqrt": F.sqrt, "cbrt": F.cbrt, "exp": F.exp, "expm1": F.expm1, "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": F.asin, "acos": F.acos,
    "atan": F.atan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": F.acosh, "atanh": F.atanh,
    "exp2": lambda x: F.pow(F.lit(2.0), x), "log": lambda x: sem.log(x, F.ln), "log2": lambda x: sem.log(x, F.log2), "log10": lambda x: sem.log(x, F.log10),
    "log1p": lambda x: F.when(x == -1, -sem.inf()).when((x < -1) | F.isnan(x), sem.nan()).otherwise(F.log1p(F.when(x > -1, x))),
    "deg2rad": F.radians, "rad2deg": F.degrees,
}
for _n, _f in _MATH.items():
    _u(_n, lambda x, t, f=_f: f(x.cast("double")), inner=_float_of)
_round = lambda x: F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5))
for _n, _f in {"ceil": F.ceil, "floor": F.floor, "trunc": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)), "round": _round}.items():
    _u(_n, lambda x, t, f=_f: sem.whole(x, f) if t.kind == "f" else x)
_u("rint", lambda x, t: F.rint(x) if t.kind == "f" else x)
_u("signum", lambda x, t: x if t.kind == "b" else F.when(x > 0, 1).when(x < 0, -1).when(x == 0, 0).otherwise(x) if t.kind == "f" else F.signum(x.cast("double")).cast("long"))
_u("isinf", lambda x, t: F.abs(x) == math.inf if t.kind == "f" else F.lit(False), outer=lambda t: BOOL)
_u("isnan", lambda x, t: F.isnan(x) if t.kind == "f" else F.lit(False), outer=lambda t: BOOL)
_u("isfinite", lambda x, t: ~F.isnan(x) & (F.abs(x) != math.inf) if t.kind == "f" else F.lit(True), outer=lambda t: BOOL)
_part = lambda t: FP64 if t == FC64 else FP32
_u("creal", lambda x, t: x["re"], "c", outer=_part)
_u("cimag", lambda x, t: x["im"], "c", outer=_part)
_u("carg", lambda x, t: F.atan2(x["im"], x["re"]), "c", outer=_part)
_u("conj", lambda x, t: _cplx(x["re"], -x["im"]), "c")
for _n, _f in {"erf": math.erf, "erfc": math.erfc, "lgamma": _safe(math.lgamma), "tgamma": _safe(math.gamma)}.items():
    _u(_n, lambda x, t, f=_f: _udf(f)(x.cast("double")), inner=_float_of)
_u("frexpx", lambda x, t: _udf(lambda v: math.frexp(v)[0])(x.cast("double")), inner=_float_of)
_u("frexpe", lambda x, t: _udf(lambda v: float(math.frexp(v)[1]))(x.cast("double")), inner=_float_of)
_u("square", lambda x, t: x & x if t.kind == "b" else x * x)
_u("signbit", lambda x, t: ((x < 0) | ((x == 0) & sem.minus_zero(x))) if t.kind == "f" else (x < 0 if t.kind == "i" else F.lit(False)), outer=lambda t: BOOL)
_u("spacing", lambda x, t: _udf(lambda v: math.copysign(math.ulp(v), v))(x.cast("double")), inner=_float_of)
for _n, _f in {"positioni": lambda i, j: i, "positioni1": lambda i, j: i + 1, "positionj": lambda i, j: j, "positionj1": lambda i, j: j + 1}.items():
    UNARY[_n] = UnaryOp(_n, _f, "biufco", positional=True)
NUMPY_UNARY = {
    "negative": "ainv", "abs": "abs", "absolute": "abs", "fabs": "abs", "cbrt": "cbrt", "rint": "rint", "sign": "signum", "exp": "exp", "exp2": "exp2", "log": "log", "log2": "log2",
    "log10": "log10", "expm1": "expm1", "log1p": "log1p", "positive": "identity", "sqrt": "sqrt", "square": "square", "reciprocal": "minv", "sin": "sin", "cos": "cos", "tan": "tan",
    "arcsin": "asin", "arccos": "acos", "arctan": "atan", "sinh": "sinh", "cosh": "cosh", "tanh": "tanh", "arcsinh": "asinh", "arccosh": "acosh", "arctanh": "atanh",
    "deg2rad": "deg2rad", "rad2deg": "rad2deg", "degrees": "rad2deg", "radians": "deg2rad", "bitwise_not": "bnot", "invert": "bnot", "logical_not": "lnot", "isfinite": "isfinite",
    "isinf": "isinf", "isnan": "isnan", "signbit": "signbit", "floor": "floor", "ceil": "ceil", "trunc": "trunc", "spacing": "spacing", "conj": "conj", "conjugate": "conj",
}

# ---------------------------------------------------------------- binary

COMMUTES = set("any pair plus times min max eq ne iseq isne lor land lxor lxnor bor band bxor bxnor hypot eq ne maximum minimum fmax fmin logaddexp logaddexp2 gcd lcm".split())


def _b(name: str, fn, types="biuf", inner=lambda t: t, outer=lambda t: t, swap=None, **meta):
    BINARY[name] = BinaryOp(name, fn, types, inner, outer, meta=meta | ({"swap": swap} if swap else {}))


def _cmul(x, y):
    return _cplx(x["re"] * y["re"] - x["im"] * y["im"], x["re"] * y["im"] + x["im"] * y["re"])


def _cdiv(x, y):
    d = y["re"] * y["re"] + y["im"] * y["im"]
    return _cplx(sem.fdiv(x["re"] * y["re"] + x["im"] * y["im"], d), sem.fdiv(x["im"] * y["re"] - x["re"] * y["im"], d))


def _plus(x, y, t):
    return x | y if t.kind == "b" else _cplx(x["re"] + y["re"], x["im"] + y["im"]) if _isc(t) else x + y


def _minus(x, y, t):
    return x != y if t.kind == "b" else _cplx(x["re"] - y["re"], x["im"] - y["im"]) if _isc(t) else x - y


def _times(x, y, t):
    return x & y if t.kind == "b" else _cmul(x, y) if _isc(t) else x * y


def _div(x, y, t):
    return x if t.kind == "b" else _cdiv(x, y) if _isc(t) else sem.fdiv(x, y) if t.kind == "f" else sem.idiv(x, y)


def _flip(f):
    return lambda x, y, t: f(y, x, t)


def _truediv(t):
    return t if t.kind in "fc" else FP64


def _min(x, y, t):
    return x & y if t.kind == "b" else sem.fmin(x, y) if t.kind == "f" else F.least(x, y)


def _max(x, y, t):
    return x | y if t.kind == "b" else sem.fmax(x, y) if t.kind == "f" else F.greatest(x, y)


def _nanmin(x, y, t):
    return x & y if t.kind == "b" else F.when(F.isnan(x) | F.isnan(y), sem.nan()).otherwise(F.least(x, y)) if t.kind == "f" else F.least(x, y)


def _nanmax(x, y, t):
    return x | y if t.kind == "b" else F.greatest(x, y)  # Spark's NaN is the greatest


BINARY["first"] = BinaryOp("first", lambda x, y, tx, ty: x, "biufco", meta={"raw": lambda a, b: a, "swap": "second"})
BINARY["second"] = BinaryOp("second", lambda x, y, tx, ty: y, "biufco", meta={"raw": lambda a, b: b, "swap": "first"})
_b("any", lambda x, y, t: y, "biufco")
_b("pair", lambda x, y, t: dt.lit(1, INT64 if t.kind == "o" else t), "biufco", outer=lambda t: INT64 if t.kind == "o" else t)
BINARY["oneb"] = BINARY["pair"]
_b("plus", _plus, "biufc")
_b("minus", _minus, "biufc", swap="rminus")
_b("rminus", _flip(_minus), "biufc", swap="minus")
_b("times", _times, "biufc")
_b("cdiv", _div, "biufc", swap="rdiv")
_b("rdiv", _flip(_div), "biufc", swap="cdiv")
_b("truediv", lambda x, y, t: _cdiv(x, y) if _isc(t) else sem.fdiv(x, y), "biufc", inner=_truediv, swap="rtruediv")
_b("rtruediv", lambda x, y, t: _cdiv(y, x) if _isc(t) else sem.fdiv(y, x), "biufc", inner=_truediv, swap="truediv")
_fdivf = lambda x, y, t: sem.whole(sem.fdiv(x, y), F.floor) if t.kind == "f" else sem.floordiv(x, y)
_b("floordiv", _fdivf, "iuf", swap="rfloordiv")
_b("rfloordiv", _flip(_fdivf), "iuf", swap="floordiv")


def _pow(x, y, t):
    return x | ~y if t.kind == "b" else F.pow(x, y) if t.kind == "f" else sem.ipow(x, y).cast("decimal(38,0)" if t == dt.UINT64 else "long")


_b("pow", _pow, swap="rpow")
_b("rpow", _flip(_pow), swap="pow")
_b("min", _min)
_b("max", _max)
_SWAP = {"lt": "gt", "gt": "lt", "le": "ge", "ge": "le"}


def _cmp(name):
    def fn(x, y, t):
        if t.kind in "co":
            return x == y if name == "eq" else x != y
        return sem.compare(name, x, y, t.kind == "f")

    return fn


for _n in ("eq", "ne", "gt", "lt", "ge", "le"):
    _b(_n, _cmp(_n), "biufco" if _n in ("eq", "ne") else "biuf", outer=lambda t: BOOL, swap=_SWAP.get(_n))
    _b(f"is{_n}", lambda x, y, t, f=_cmp(_n): _as(f(x, y, t), t) if t.kind != "c" else dt.lit(0, t), "biuf", swap=f"is{_SWAP[_n]}" if _n in _SWAP else None)
_LOGIC = {"lor": lambda a, b: a | b, "land": lambda a, b: a & b, "lxor": lambda a, b: a != b, "lxnor": lambda a, b: a == b}
for _n, _f in _LOGIC.items():
    _b(_n, lambda x, y, t, f=_f: _as(f(dt.truth(x, t), dt.truth(y, t)), t))
for _n, _f in {"bor": lambda x, y: x.bitwiseOR(y), "band": lambda x, y: x.bitwiseAND(y), "bxor": lambda x, y: x.bitwiseXOR(y), "bxnor": lambda x, y: F.bitwise_not(x.bitwiseXOR(y))}.items():
    _b(_n, lambda x, y, t, f=_f: _bits(f, t, x, y), "iu")
_bit = lambda y: F.call_function("shiftleft", F.lit(1).cast("long"), (y - 1).cast("int"))
_inrange = lambda y, t: (y >= 1) & (y <= t.bits)
_b("bget", lambda x, y, t: _bits(lambda a, b: F.when(_inrange(b, t), (a.bitwiseAND(_bit(b)) != 0).cast("long")).otherwise(0), t, x, y), "iu")
_b("bset", lambda x, y, t: _bits(lambda a, b: F.when(_inrange(b, t), a.bitwiseOR(_bit(b))).otherwise(a), t, x, y), "iu")
_b("bclr", lambda x, y, t: _bits(lambda a, b: F.when(_inrange(b, t), a.bitwiseAND(F.bitwise_not(_bit(b)))).otherwise(a), t, x, y), "iu")


def _bshift(x, y, t):
    if t == dt.UINT64:  # a negative count arrives as its unsigned twin
        a, k = dt.signed(x), dt.signed(y)
        n = F.least(F.abs(k), F.lit(63)).cast("int")
        left = F.when(k >= 64, F.lit(0)).otherwise(F.call_function("shiftleft", a, n))
        right = F.when(k <= -64, F.lit(0)).otherwise(F.call_function("shiftrightunsigned", a, n))
        return dt.unsigned(F.when(k >= 0, left).otherwise(right))
    n = F.least(F.abs(y), F.lit(63)).cast("int")
    left = F.when(y >= t.bits, F.lit(0)).otherwise(F.call_function("shiftleft", x, n))
    right = F.when(y <= -t.bits, F.when(x < 0, F.lit(-1)).otherwise(F.lit(0))).otherwise(F.call_function("shiftright", x, n))
    return F.when(y >= 0, left).otherwise(right)


_b("bshift", _bshift, "iu")
_b("atan2", lambda x, y, t: F.atan2(x, y), inner=_float_of)
_b("hypot", lambda x, y, t: F.hypot(x, y), inner=_float_of)
_b("fmod", lambda x, y, t: F.when((y == 0) | (F.abs(x) == math.inf), sem.nan()).otherwise(x % F.when(y == 0, F.lit(1.0)).otherwise(y)), inner=_float_of)
_b("remainder", lambda x, y, t: F.when(y == 0, sem.nan()).otherwise(x - y * F.rint(sem.fdiv(x, y))), inner=_float_of)
_b("copysign", lambda x, y, t: F.when((y < 0) | ((y == 0) & sem.minus_zero(y)), -F.abs(x)).otherwise(F.abs(x)), inner=_float_of)
_b("ldexp", lambda x, y, t: x * F.pow(F.lit(2.0), y), inner=_float_of)
_b("cmplx", lambda x, y, t: _cplx(x, y), "f", outer=lambda t: FC64 if t == FP64 else FC32)
_b("absfirst", lambda x, y, t: F.abs(x) if t.kind in "if" else x)
_b("abssecond", lambda x, y, t: F.abs(y) if t.kind in "if" else y)
_b("binom", lambda x, y, t: _udf(lambda n, k: c if 0 <= k <= n and (c := math.comb(n, k)) < 2**63 else 0, "long")(x, y), "iu")
_b("numpy_mod", lambda x, y, t: sem.fmod_floor(x, y) if t.kind == "f" else sem.mod(x, y), "iuf")
_b("maximum", _nanmax)
_b("minimum", _nanmin)
_lae = lambda x, y: F.when(x == y, x + math.log(2)).otherwise(F.greatest(x, y) + F.log1p(F.exp(-F.abs(x - y))))
_b("logaddexp", lambda x, y, t: _lae(x, y), inner=_float_of)
_b("logaddexp2", lambda x, y, t: _lae(x * math.log(2), y * math.log(2)) / math.log(2), inner=_float_of)
_b("gcd", lambda x, y, t: _udf(math.gcd, "long")(x, y), "iu")
_b("lcm", lambda x, y, t: _udf(math.lcm, "long")(x, y), "iu")
_b("nextafter", lambda x, y, t: _udf(math.nextafter)(x.cast("double"), y.cast("double")), inner=_float_of)
_b("float_power", lambda x, y, t: F.pow(x, y), inner=lambda t: FP64)
_b("left_shift", lambda x, y, t: F.when(y >= t.bits, F.lit(0)).otherwise(_bits(lambda a, b: F.call_function("shiftleft", a, b.cast("int")), t, x, F.least(y, F.lit(63)))), "iu")
_b("right_shift", lambda x, y, t: F.when((y >= t.bits) & F.lit(t.kind == "u"), F.lit(0)).otherwise(_bits(lambda a, b: F.call_function("shiftrightunsigned" if t == dt.UINT64 else "shiftright", a, b.cast("int")), t, x, F.least(y, F.lit(63)))), "iu")
_at = {"firsti": lambda a: a["ix"], "firstj": lambda a: a["jx"], "secondi": lambda a: a["iy"], "secondj": lambda a: a["jy"]}
for _n, _f in _at.items():
    BINARY[_n] = BinaryOp(_n, _f, "biufco", positional=True, meta={"coords": True, "swap": ("second" if _n.startswith("first") else "first") + ("j" if _n.endswith("i") else "i")})
    BINARY[f"{_n}1"] = BinaryOp(f"{_n}1", lambda a, f=_f: f(a) + 1, "biufco", positional=True, meta={"coords": True, "swap": ("second" if _n.startswith("first") else "first") + ("j1" if _n.endswith("i") else "i1")})

def isclose(rel_tol: float = 1e-7, abs_tol: float = 0.0) -> BinaryOp:
    def fn(x, y, t):
        near = F.abs(x - y) <= F.greatest(F.greatest(F.abs(x), F.abs(y)) * rel_tol, F.lit(abs_tol))
        return (x == y) & ~F.isnan(x) | (near & (F.abs(x) != math.inf) & (F.abs(y) != math.inf) & ~F.isnan(x) & ~F.isnan(y))

    return BinaryOp("isclose", fn, "biuf", inner=lambda t: FP64, outer=lambda t: BOOL)


NUMPY_BINARY = {
    "add": "plus", "subtract": "minus", "multiply": "times", "divide": "truediv", "true_divide": "truediv", "floor_divide": "floordiv", "power": "pow", "float_power": "float_power",
    "remainder": "numpy_mod", "mod": "numpy_mod", "fmod": "fmod", "gcd": "gcd", "lcm": "lcm", "arctan2": "atan2", "hypot": "hypot", "logaddexp": "logaddexp", "logaddexp2": "logaddexp2",
    "bitwise_and": "band", "bitwise_or": "bor", "bitwise_xor": "bxor", "left_shift": "left_shift", "right_shift": "right_shift", "greater": "gt", "greater_equal": "ge", "less": "lt",
    "less_equal": "le", "equal": "eq", "not_equal": "ne", "logical_and": "land", "logical_or": "lor", "logical_xor": "lxor", "maximum": "maximum", "minimum": "minimum", "fmax": "max",
    "fmin": "min", "copysign": "copysign", "nextafter": "nextafter", "ldexp": "ldexp",
}

# ---------------------------------------------------------------- index-unary and select


def _iu(name, fn, out=BOOL):
    INDEXUNARY[name] = (SelectOp if out == BOOL else IndexUnaryOp)(name, fn, "biufco", meta={"out": out})


_iu("rowindex", lambda x, i, j, k, t: (i + k).cast("long"), INT64)
_iu("colindex", lambda x, i, j, k, t: (j + k).cast("long"), INT64)
_iu("diagindex", lambda x, i, j, k, t: (j - i + k).cast("long"), INT64)
INDEXUNARY["index"] = INDEXUNARY["rowindex"]
_iu("tril", lambda x, i, j, k, t: j <= i + k)
_iu("triu", lambda x, i, j, k, t: j >= i + k)
_iu("diag", lambda x, i, j, k, t: j == i + k)
_iu("offdiag", lambda x, i, j, k, t: j != i + k)
for _n, _f in {"rowle": lambda i, j, k: i <= k, "rowgt": lambda i, j, k: i > k, "colle": lambda i, j, k: j <= k, "colgt": lambda i, j, k: j > k, "indexle": lambda i, j, k: i <= k, "indexgt": lambda i, j, k: i > k}.items():
    _iu(_n, lambda x, i, j, k, t, f=_f: f(i, j, k))
for _n in ("eq", "ne", "lt", "le", "gt", "ge"):
    _iu(f"value{_n}", lambda x, i, j, k, t, f=_cmp(_n): f(x, k, t))
SELECT = {n: o for n, o in INDEXUNARY.items() if o.meta["out"] == BOOL}

# ---------------------------------------------------------------- monoids


@dataclass(frozen=True)
class Monoid:
    """An associative and commutative operator with an identity, as a Spark aggregate.

    agg(v, type) is an aggregate with map-side parts, but for user monoids without
    one, whose group is folded from a collected list (documented in the README).
    """

    name: str
    binaryop: BinaryOp
    agg: Callable
    identity_of: Callable
    is_idempotent: bool = False
    types: str = "biuf"
    pinned: DataType | None = None

    def __getitem__(self, t) -> Monoid:
        return replace(self, pinned=dt.lookup(t))

    def __contains__(self, t) -> bool:
        return dt.lookup(t).kind in self.types

    def result(self, t: DataType) -> DataType:
        return self.binaryop.result(self.pinned or t)

    def identity(self, t):
        return self.identity_of(dt.lookup(t))

    @property
    def identities(self) -> dict:
        return {t: self.identity_of(t) for t in dt.BUILTIN if t.kind in self.types}

    def reduce(self, v: Column, t: DataType) -> Column:
        if t.kind not in self.types:
            raise TypeError(f"{self.name} has no {t}")
        w = self.binaryop.computing(self.pinned or t)
        return _finish(self.agg(dt.wide(dt.cast(v, t, w), w), w), self.result(t))

    def __call__(self, *args, **kwargs):
        from lattica.operators.expr import call

        return call(self, *args, **kwargs)

    def __repr__(self) -> str:
        return f"monoid.{self.name}"


def _limit(t: DataType, low: bool):
    if t.kind == "b":
        return not low
    if t.kind == "f":
        return -math.inf if low else math.inf
    return (0 if t.kind == "u" else -(1 << (t.bits - 1))) if low else (1 << (t.bits - (t.kind == "i"))) - 1


def _m(name, agg, identity, idem=False, types="biuf", op=None):
    MONOIDS[name] = Monoid(name, BINARY[op or name], agg, identity, idem, types)


def _sum(v, t):
    if t.kind == "c":
        return F.struct(F.sum(v["re"]).alias("re"), F.sum(v["im"]).alias("im"))
    return F.bool_or(v) if t.kind == "b" else F.sum(v)


def _product(v, t):
    """Exact for integers below 2^53 in magnitude, beyond by folding the group."""
    if t.kind == "b":
        return F.bool_and(v)
    if t.kind == "f":
        return F.product(v)
    zero = F.lit(0).cast("decimal(38,0)")
    return F.when(F.abs(F.product(v.cast("double"))) < 2.0**53, F.product(v.cast("double")).cast("long")).otherwise(_fold(v, F.lit(1).cast("long"), lambda a, b: a * b)) if t != dt.UINT64 else F.reduce(F.collect_list(v), zero + 1, lambda a, b: (a * b).cast("decimal(38,0)"))


def _fold(v, zero, f):
    return F.reduce(F.collect_list(v), zero, f)


def _aggmin(v, t):
    return F.bool_and(v) if t.kind == "b" else F.coalesce(F.min(sem.nan_to_null(v)), F.min(v)) if t.kind == "f" else F.min(v)


def _aggmax(v, t):
    return F.bool_or(v) if t.kind == "b" else F.coalesce(F.max(sem.nan_to_null(v)), F.max(v)) if t.kind == "f" else F.max(v)


def _parity(v, t):
    return F.sum(dt.truth(v, t).cast("int")) % 2


_m("plus", _sum, lambda t: 0, types="iufc")
_m("times", _product, lambda t: 1)
_m("min", _aggmin, lambda t: _limit(t, False), True)
_m("max", _aggmax, lambda t: _limit(t, True), True)
_m("any", lambda v, t: F.min(v), lambda t: 0, True, "biufco")
_m("lor", lambda v, t: _as(F.bool_or(dt.truth(v, t)), t), lambda t: False, True)
_m("land", lambda v, t: _as(F.bool_and(dt.truth(v, t)), t), lambda t: True, True)
_m("lxor", lambda v, t: _as(_parity(v, t) == 1, t), lambda t: False)
_m("lxnor", lambda v, t: _as((F.count(F.lit(1)) - F.sum(dt.truth(v, t).cast("int"))) % 2 == 0, t), lambda t: True)
_m("eq", lambda v, t: (F.count(F.lit(1)) - F.sum(v.cast("int"))) % 2 == 0, lambda t: True, types="b")
_m("bor", lambda v, t: _bits(F.bit_or, t, v), lambda t: 0, True, "iu")
_m("band", lambda v, t: _bits(F.bit_and, t, v), lambda t: -1 if t.kind == "i" else (1 << t.bits) - 1, True, "iu")
_m("bxor", lambda v, t: _bits(F.bit_xor, t, v), lambda t: 0, False, "iu")
_m("bxnor", lambda v, t: _bits(lambda a: F.when(F.count(F.lit(1)) % 2 == 1, F.bit_xor(a)).otherwise(F.bitwise_not(F.bit_xor(a))), t, v), lambda t: -1 if t.kind == "i" else (1 << t.bits) - 1, False, "iu")
_m("maximum", lambda v, t: F.bool_or(v) if t.kind == "b" else F.max(v), lambda t: _limit(t, True), True)
_m("minimum", lambda v, t: F.bool_and(v) if t.kind == "b" else F.when(F.bool_or(F.isnan(v)), sem.nan()).otherwise(F.min(v)) if t.kind == "f" else F.min(v), lambda t: _limit(t, False), True)
_m("hypot", lambda v, t: F.sqrt(F.sum(v.cast("double") * v)), lambda t: 0, types="iuf")


def _logsum(v, base=1.0):
    """log(sum(exp(v))) in one expression, for values within +-1200; ``collection.folded`` is exact for all values."""
    v = v.cast("double") * base
    top, shift = F.max(v), 600.0
    at = lambda s: F.ln(F.sum(F.exp(F.least(v - s, F.lit(700.0))))) + s
    return F.when(top > shift, at(shift)).when(top < -shift, at(-shift)).otherwise(at(0.0)) / base


_m("logaddexp", lambda v, t: _logsum(v), lambda t: -math.inf, types="iuf")
_m("logaddexp2", lambda v, t: _logsum(v, math.log(2)), lambda t: -math.inf, types="iuf")
_m("gcd", lambda v, t: _gcd_agg(v), lambda t: 0, True, "iu")
NUMPY_MONOID = {
    "add": "plus", "multiply": "times", "logaddexp": "logaddexp", "logaddexp2": "logaddexp2", "gcd": "gcd", "hypot": "hypot", "bitwise_and": "band", "bitwise_or": "bor",
    "bitwise_xor": "bxor", "equal": "eq", "logical_and": "land", "logical_or": "lor", "logical_xor": "lxor", "maximum": "maximum", "minimum": "minimum", "fmax": "max", "fmin": "min",
}


def _gcd_agg(v):
    @F.pandas_udf("long")
    def run(s: pd.Series) -> int:
        return math.gcd(*(int(x) for x in s))

    return run(v)


# ---------------------------------------------------------------- semirings


@dataclass(frozen=True)
class Semiring:
    monoid: Monoid
    binaryop: BinaryOp
    pinned: DataType | None = None

    @property
    def name(self) -> str:
        return f"{self.monoid.name}_{self.binaryop.name}"

    @property
    def is_positional(self) -> bool:
        return self.binaryop.positional

    @property
    def commutes_to(self):
        swapped = self.binaryop.commutes_to
        return Semiring(self.monoid, swapped) if swapped else None

    def __getitem__(self, t) -> Semiring:
        t = dt.lookup(t)
        return replace(self, pinned=t, binaryop=self.binaryop if self.binaryop.positional or self.binaryop.meta.get("raw") else self.binaryop[t])

    def out(self, tx, ty) -> DataType:
        return self.monoid.result(self.binaryop.out(tx, ty))

    def __call__(self, *args, **kwargs):
        from lattica.operators.expr import call

        return call(self, *args, **kwargs)

    def __repr__(self) -> str:
        return f"semiring.{self.name}"


def get_semiring(monoid, binaryop) -> Semiring:
    return Semiring(as_monoid(monoid), as_binary(binaryop))


SEMIRINGS: dict[str, Semiring] = {}


def register_semiring(name, monoid, binaryop) -> Semiring:
    """A semiring under a name of its own."""
    return SEMIRINGS.setdefault(name, get_semiring(monoid, binaryop))


# ---------------------------------------------------------------- names

_SYMBOL = {
    "+": "plus", "-": "minus", "*": "times", "/": "truediv", "//": "floordiv", "%": "numpy_mod", "**": "pow", "&": "land", "|": "lor", "^": "lxor",
    "==": "eq", "!=": "ne", "<": "lt", ">": "gt", "<=": "le", ">=": "ge", "<<": "left_shift", ">>": "right_shift", "@": "plus_times",
}
_USYMBOL = {"-": "ainv", "~": "lnot"}


def _typed(name: str):
    name = name.strip()
    if name.endswith("]") and "[" in name:
        head, t = name[:-1].split("[", 1)
        return head, t
    return name, None


def _pin(o, t):
    return o[{"int": int, "float": float, "bool": bool}.get(t, t)] if t else o


def as_unary(x):
    if isinstance(x, UnaryOp):
        return x
    if x in (abs,):
        return UNARY["abs"]
    if isinstance(x, str):
        n, t = _typed(x)
        n = _USYMBOL.get(n, n).removeprefix("numpy.").removeprefix("ss.")
        return _pin(UNARY[n if n in UNARY else NUMPY_UNARY[n]], t)
    if callable(x):
        return UnaryOp(getattr(x, "__name__", "lambda"), lambda c, t: x(c), "biufco")
    raise TypeError(f"not a unary operator: {x!r}")


def as_binary(x):
    if isinstance(x, BinaryOp):
        return x
    if isinstance(x, Monoid):
        return x.binaryop
    if x in (min, max):
        return BINARY[x.__name__]
    if isinstance(x, str):
        n, t = _typed(x)
        n = _SYMBOL.get(n, n).removeprefix("numpy.").removeprefix("ss.")
        return _pin(BINARY[n if n in BINARY else NUMPY_BINARY[n]], t)
    if callable(x) and not isinstance(x, Op | Semiring):
        return BinaryOp(getattr(x, "__name__", "lambda"), lambda a, b, t: x(a, b), "biufco")
    raise TypeError(f"not a binary operator: {x!r}")


def as_monoid(x):
    if isinstance(x, Monoid):
        return x
    if x in (min, max, any, all):
        return MONOIDS[{"any": "lor", "all": "land"}.get(x.__name__, x.__name__)]
    if isinstance(x, BinaryOp):
        m = MONOIDS.get(x.name)
        if m is None:
            raise TypeError(f"{x.name} has no monoid")
        return _pin(m, x.pinned)
    if isinstance(x, str):
        n, t = _typed(x)
        n = _SYMBOL.get(n, n).removeprefix("numpy.").removeprefix("ss.")
        return _pin(MONOIDS[n if n in MONOIDS else NUMPY_MONOID[n]], t)
    raise TypeError(f"not a monoid: {x!r}")


def as_semiring(x):
    if isinstance(x, Semiring):
        return x
    if isinstance(x, str):
        n, t = _typed(x)
        if n in SEMIRINGS:
            return _pin(SEMIRINGS[n], t)
        if n == "@":
            n = "plus_times"
        if "." in n and "_" not in n:
            a, b = n.split(".", 1)
        else:
            a, b = n.split("_", 1)
        s = Semiring(as_monoid(a), as_binary({"div": "cdiv"}.get(b, b)))
        return _pin(s, t)
    raise TypeError(f"not a semiring: {x!r}")


def as_index(x):
    if isinstance(x, IndexUnaryOp):
        return x
    if isinstance(x, str):
        return INDEXUNARY[f"value{_SYMBOL[x]}" if x in _SYMBOL and f"value{_SYMBOL[x]}" in INDEXUNARY else x]
    if callable(x):
        return register_indexunary(None, x)
    raise TypeError(f"not an index operator: {x!r}")


# ---------------------------------------------------------------- user operators


def _out(t):
    return (lambda _: dt.lookup(t)) if t is not None else (lambda w: w)


def _checked(fn, n: int):
    """fn, if it turns n columns into a column; looked into where a session is there to make columns."""
    if SparkSession.getActiveSession() is None:
        return fn
    try:
        out = fn(*(F.col(f"c{i}") for i in range(n)))
    except Exception as e:
        raise UdfParseError(f"{getattr(fn, '__name__', fn)} does not take {n} columns: {e}") from e
    if not isinstance(out, Column):
        raise UdfParseError(f"{getattr(fn, '__name__', fn)} does not give a column")
    return fn


def register_unary(name, fn, dtype=None):
    """fn: Column -> Column. Without a name the operator is anonymous."""
    _checked(fn, 1)
    o = UnaryOp(name or getattr(fn, "__name__", "lambda"), lambda x, t: fn(x), "biufco", outer=_out(dtype))
    return UNARY.setdefault(name, o) if name else o


def register_binary(name, fn, dtype=None):
    """fn: (Column, Column) -> Column."""
    _checked(fn, 2)
    o = BinaryOp(name or getattr(fn, "__name__", "lambda"), lambda x, y, t: fn(x, y), "biufco", outer=_out(dtype))
    return BINARY.setdefault(name, o) if name else o


def register_indexunary(name, fn, dtype=BOOL):
    """fn: (value, row, column, thunk) -> Column."""
    o = (SelectOp if dt.lookup(dtype) == BOOL else IndexUnaryOp)(name or "lambda", lambda x, i, j, k, t: fn(x, i, j, k), "biufco", meta={"out": dt.lookup(dtype)})
    if name:
        INDEXUNARY.setdefault(name, o)
        if o.is_select:
            SELECT.setdefault(name, o)
    return o


def register_indexbinary(name, fn, dtype=None):
    """fn: (x, ix, jx, y, iy, jy, theta) -> Column."""
    o = IndexBinaryOp(name or "lambda", fn, _out(dtype))
    return INDEXBINARY.setdefault(name, o) if name else o


def register_monoid(name, binaryop, identity, is_idempotent=False, agg=None):
    """agg: Column -> Column aggregate with map-side parts; without it a group's values are folded."""
    op = as_binary(binaryop)
    fold = lambda v, t: F.reduce(F.collect_list(v), dt.lit(identity, t), lambda a, b: op.fn(a, b, t))
    m = Monoid(name or op.name, op, (lambda v, t: agg(v)) if agg else fold, lambda t: identity, is_idempotent, "biufco")
    return MONOIDS.setdefault(name, m) if name else m
