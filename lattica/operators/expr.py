"""Delayed operations: expressions, infix nodes, and operators applied to them."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame

from lattica.functions import agg as aggs
from lattica.functions import ops
from lattica.functions.dtypes import DataType


RECORDERS: list = []


def record(what: str) -> None:
    """Notes an operation with all recorders that run."""
    for r in RECORDERS:
        r.data.append(what)


class Expr:
    """An operation that has captured its operands' DataFrames but run nothing.

    make(keep) gives the result's rows; keep, if given, narrows rows to a mask's
    coordinates and is applied as early as the operation can (before aggregation).
    Attributes of the result are available as if it were computed.
    """

    def __init__(self, kind: type, dtype: DataType, shape: tuple, make: Callable[[Any], DataFrame], name: str = ""):
        self.kind, self.dtype, self.shape, self.make, self.name = kind, dtype, shape, make, name
        self._value = None
        self.compared = None  # (collection, comparison, scalar) of A < 3 and the like
        record(f"{kind.__name__}[{dtype}]{tuple(shape)} = {name}")

    def new(self, dtype=None, *, mask=None, name=None):
        """A new collection with the result; mask keeps its entries only."""
        if mask is None and dtype is None:
            if self._value is None:
                self._value = self.kind.of(self.make(None), self.dtype, self.shape)
            return self._value.dup()
        df = self.make(mask.keep if mask is not None else None)
        out = self.kind.of(df, self.dtype, self.shape)
        return out if dtype is None else out.dup(dtype)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if self._value is None:
            self._value = self.kind.of(self.make(None), self.dtype, self.shape)
        return getattr(self._value, name)

    def __repr__(self) -> str:
        return f"{self.kind.__name__}Expression({self.name}, {self.dtype}, shape={self.shape})"


for _n in ("__and__", "__or__", "__matmul__", "__add__", "__sub__", "__mul__", "__truediv__", "__floordiv__", "__mod__", "__pow__", "__neg__", "__invert__", "__abs__", "__xor__",
           "__lt__", "__gt__", "__le__", "__ge__", "__eq__", "__ne__", "__getitem__", "__contains__", "__iter__", "__rand__", "__ror__", "__rmatmul__", "__radd__", "__rsub__", "__rmul__",
           "__rtruediv__", "__rfloordiv__", "__rmod__", "__rpow__", "__rxor__", "__divmod__", "__bool__", "__float__", "__int__", "__index__"):
    setattr(Expr, _n, lambda self, *a, _n=_n: getattr(self.new(), _n)(*a))
Expr.__hash__ = object.__hash__


class Infix:
    """``A & B``, ``A | B`` or ``A @ B`` that waits for its operator."""

    def __init__(self, symbol: str, left, right):
        self.symbol, self.left, self.right = symbol, left, right

    def using(self, op, **defaults) -> Expr:
        if self.symbol == "@":
            return self.left._matmul(self.right, ops.as_semiring(op))
        if self.symbol == "&":
            return self.left.ewise_mult(self.right, op)
        if defaults:
            return self.left.ewise_union(self.right, op, **defaults)
        return self.left.ewise_add(self.right, op)

    def _default(self) -> Expr:
        if self.symbol == "@":
            return self.using("plus_times")
        if self.left.dtype.kind != "b" or self.right.dtype.kind != "b":
            raise TypeError(f"choose an operator for {self.symbol}, such as binary.plus(A {self.symbol} B)")
        return self.using("lor" if self.symbol == "|" else "land")

    def new(self, *a, **k):
        return self._default().new(*a, **k)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self._default(), name)


def call(op, *args, **kwargs):
    """An operator called on an infix node, a collection, or a collection and a scalar."""
    from lattica.operators.collection import Collection

    first = args[0]
    if isinstance(first, Infix):
        return first.using(op, **kwargs)
    args = [a.new() if isinstance(a, Expr) else a for a in args]
    first = args[0]
    if isinstance(op, ops.UnaryOp):
        return first.apply(op)
    if isinstance(op, ops.SelectOp):
        return first.select(op, *args[1:], **kwargs)
    if isinstance(op, ops.IndexUnaryOp):
        return first.apply(op, right=args[1] if len(args) > 1 else kwargs.get("thunk", 0))
    if len(args) == 2:
        if isinstance(first, Collection):
            return first.apply(op, right=args[1])
        return args[1].apply(op, left=first)
    raise TypeError(f"cannot apply {op!r} to {args!r}")


class Namespace:
    """Attribute access to a table of operators by name."""

    def __init__(self, find: Callable[[str], Any], names: Callable[[], Any], **more):
        self._find, self._names = find, names
        self.__dict__.update(more)

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        try:
            return self._find(name)
        except (KeyError, ValueError) as e:
            raise AttributeError(name) from e

    def __dir__(self):
        return sorted(self._names())

    def from_string(self, text: str):
        return self._find(text)


def _any(name: str):
    for find in (ops.as_unary, ops.as_binary, ops.as_monoid, ops.as_semiring, ops.as_index):
        try:
            return find(name)
        except (KeyError, ValueError, TypeError):
            pass
    return aggs.AGG[name]


def _by(axis: str, what: str):
    """select.value(A > 3), select.row(A <= 5) and the like: the comparison says what is kept."""

    def choose(e):
        if getattr(e, "compared", None) is None:
            raise TypeError(f"select.{what} takes a comparison with a scalar, such as A > 3")
        a, op, k = e.compared
        if axis == "value":
            return a.select(f"value{op}", k)
        names = {"le": ("le", 0), "gt": ("gt", 0), "lt": ("le", -1), "ge": ("gt", -1)}
        if op not in names:
            raise TypeError(f"select.{what} has no {op}")
        tail, shift = names[op]
        return a.select(f"{axis}{tail}", int(k) + shift)

    return choose


def _numpy(find, table):
    return Namespace(lambda n: find(table[n]), lambda: table)


unary = Namespace(ops.as_unary, lambda: ops.UNARY, numpy=_numpy(ops.as_unary, ops.NUMPY_UNARY), register_new=ops.register_unary, register_anonymous=lambda f, dtype=None: ops.register_unary(None, f, dtype))
binary = Namespace(ops.as_binary, lambda: ops.BINARY, numpy=_numpy(ops.as_binary, ops.NUMPY_BINARY), register_new=ops.register_binary, register_anonymous=lambda f, dtype=None: ops.register_binary(None, f, dtype), isclose=ops.isclose)
monoid = Namespace(ops.as_monoid, lambda: ops.MONOIDS, numpy=_numpy(ops.as_monoid, ops.NUMPY_MONOID), register_new=ops.register_monoid, register_anonymous=lambda *a, **k: ops.register_monoid(None, *a, **k))
semiring = Namespace(ops.as_semiring, lambda: (f"{m}_{b}" for m in ops.MONOIDS for b in ops.BINARY), register_new=ops.register_semiring, register_anonymous=lambda m, b: ops.get_semiring(m, b), get_semiring=ops.get_semiring)
semiring.numpy = Namespace(lambda n: ops.get_semiring(ops.NUMPY_MONOID[n.split("_", 1)[0]] if n.split("_", 1)[0] in ops.NUMPY_MONOID else ops.NUMPY_MONOID["_".join(n.split("_")[:2])], ops.NUMPY_BINARY[n.split("_", 1)[1]] if n.split("_", 1)[1] in ops.NUMPY_BINARY and n.split("_", 1)[0] in ops.NUMPY_MONOID else ops.NUMPY_BINARY["_".join(n.split("_")[2:])]), lambda: ())
indexunary = Namespace(ops.as_index, lambda: ops.INDEXUNARY, register_new=ops.register_indexunary, register_anonymous=lambda f, dtype="BOOL": ops.register_indexunary(None, f, dtype))
indexbinary = Namespace(lambda n: ops.INDEXBINARY[n], lambda: ops.INDEXBINARY, register_new=ops.register_indexbinary, register_anonymous=lambda f, dtype=None: ops.register_indexbinary(None, f, dtype))
select = Namespace(lambda n: ops.SELECT[n], lambda: ops.SELECT, value=_by("value", "value"), row=_by("row", "row"), column=_by("col", "column"), index=_by("index", "index"), register_new=ops.register_indexunary, register_anonymous=lambda f: ops.register_indexunary(None, f))
agg = Namespace(lambda n: aggs.AGG[n], lambda: aggs.AGG, ss=Namespace(lambda n: aggs.AGG[n], lambda: aggs.AGG), custom=aggs.custom)
op = Namespace(_any, lambda: {*ops.UNARY, *ops.BINARY, *ops.MONOIDS, *ops.INDEXUNARY, *aggs.AGG})
