"""Matrix, Vector and Scalar: coordinate DataFrames with a type and a shape.

A missing entry is an absent row. A collection holds a reference to a DataFrame that
``<<`` replaces; expressions capture the references they were built with, so
``w << w @ A`` reads the old w. Nothing runs until a value is asked for.
"""

from __future__ import annotations

import atexit
import math
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.exceptions import DimensionMismatch, DomainMismatch, IndexOutOfBound, InvalidValue, OutputNotEmpty
from lattica.functions import agg as aggs
from lattica.functions import dtypes as dt
from lattica.functions import ops
from lattica.functions.dtypes import BOOL, FP64, INT64
from lattica.operators import mask as masks
from lattica.operators.expr import Expr, Infix
from lattica.operators.index import Index

#: Dense fills of more cells than this are refused: they would materialise a shape.
MAX_DENSE = 1 << 32
#: Input bytes for each partition of an explicit exchange, the number of such pieces that are left to Spark,
#: and Spark's spark.shuffle.sort.bypassMergeThreshold.
PIECE, FEW, DIRECT = 4 << 20, 24, 200
#: Results of at most this many cells are folded before the exchange: their parts are small whatever the input.
SMALL_SHAPE = 1 << 22
#: An inner index of more than SIDE * SIDE products is a hub: they are made in cells of about SIDE rows by SIDE columns.
#: Counting reads the factors again, so plans of over LEAVES inputs (products of products) are left uncounted.
SIDE, LEAVES = 1 << 11, 32


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def _plain(x):
    return x.item() if isinstance(x, np.generic) else x


def _shared(sc) -> str:
    """The session's checkpoint folder."""
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or "cluster" in sc.master:
            raise InvalidValue("set spark.checkpoint.dir to a folder that the driver and all executors share")
        import tempfile

        sc.setCheckpointDir(tempfile.mkdtemp(prefix="lattica-"))
    return sc.getCheckpointDir()


def fixed(df: DataFrame) -> DataFrame:
    """df written once to the session's checkpoint folder: later uses read the same rows, and lineage ends here."""
    _shared(df.sparkSession.sparkContext)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """As fixed, but as Parquet: smaller, read by columns, and of a size that the planner knows. Goes with the driver's process."""
    spark = df.sparkSession
    path = f"{_shared(spark.sparkContext)}/lattica-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _drop(spark, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may have ended before the process
        pass


def pieces(*dfs: DataFrame) -> int:
    """Partitions of PIECE bytes of the files that the plans read; 0 if these are few, or not known. Runs nothing.

    Up to DIRECT of them a task writes each straight to its file; with more it holds rows in memory to sort
    them by partition, so pieces are larger before that number is passed.
    """
    total = 0
    for df in dfs:
        leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves().iterator()
        while leaves.hasNext():
            n = int(str(leaves.next().stats().sizeInBytes()))
            total += n if n < 1 << 50 else 0
    n = total // PIECE
    return 0 if n <= FEW else min(n, max(DIRECT, n // 8))


def spread(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """df by hash of its keys in n partitions, so that a task's share does not grow with the input; as it is for n of 0."""
    return df.repartition(n, *keys) if n else df


def hubs(x: DataFrame, y: DataFrame, n: int) -> DataFrame:
    """Inner indices of too many products for one task, and the number of parts that their rows and columns go in.

    Whole entries are counted, by exchanges that differ in no column from those of the product: they are made once. A broadcast
    of it is small: it has at most a row for each SIDE * SIDE products.
    """
    p = spread(x.select("i", F.col("k").alias("hub"), "x"), n, "hub").groupBy("hub").agg(F.expr("count(i, x)").alias("p"))
    q = spread(y.select(F.col("k").alias("hub"), "j", "y"), n, "hub").groupBy("hub").agg(F.expr("count(j, y)").alias("q"))
    many = p.join(q, "hub").where(F.col("p").cast("double") * F.col("q") > SIDE * SIDE)
    return F.broadcast(many.select(F.col("hub").alias("k"), F.ceil(F.col("p") / SIDE).alias("p"), F.ceil(F.col("q") / SIDE).alias("q")))


def met(x: DataFrame, y: DataFrame, n: int) -> DataFrame:
    """Entries of x (i, k, x) and y (k, j, y) that meet in k, in n partitions; those of hubs meet in cells, by hash of i and j.

    Without hubs adaptive execution drops the cells once they are counted. The outer join stands for an anti join, which
    would be pushed below the exchanges of x.
    """
    out = ["i", "j", "k", "x", "y"]
    if not n or sum(df._jdf.queryExecution().optimizedPlan().collectLeaves().size() for df in (x, y)) > LEAVES:
        return spread(x, n, "k").join(spread(y, n, "k"), "k").select(*out)
    hub = hubs(x, y, n)
    few = spread(x, n, "k").join(hub, "k", "left").where(F.col("p").isNull() & F.col("q").isNull())  # both: one broadcast for all
    row, column = F.pmod(F.xxhash64("i"), F.col("p")), F.pmod(F.xxhash64("j"), F.col("q"))
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.col(parts) - 1))
    across = x.join(hub, "k").select("i", "k", "x", "q", row.alias("r"), each("q").alias("c")).select("i", "k", "x", (F.col("r") * F.col("q") + F.col("c")).alias("cell"))
    down = y.join(hub, "k").select("k", "j", "y", "q", column.alias("c"), each("p").alias("r")).select("k", "j", "y", (F.col("r") * F.col("q") + F.col("c")).alias("cell"))
    many = spread(across, n, "k", "cell").join(spread(down, n, "k", "cell"), ["k", "cell"])
    return few.join(spread(y, n, "k"), "k").select(*out).unionAll(many.select(*out))


def folded(df: DataFrame, keys: list[str], by, t, at: Column | None = None) -> DataFrame:
    """One aggregation of v (of type t) per key by a monoid or an aggregator, with map-side parts.

    logaddexp shifts by each group's largest value, which is one more aggregate and a join.
    """
    base = {"logaddexp": 1.0, "logaddexp2": math.log(2)}.get(by.name)
    if base is None:
        f = by.reduce(F.col("v"), t) if at is None else by.reduce(F.col("v"), t, at)
        return df.groupBy(*keys).agg(f.alias("v")) if keys else df.agg(f.alias("v"), F.count(F.lit(1)).alias("n")).where("n > 0").select("v")
    df = df.select(*keys, dt.cast(F.col("v"), t, FP64).alias("v"))
    top = df.groupBy(*keys).agg(F.max("v").alias("top"))
    df = df.join(top, keys) if keys else df.crossJoin(F.broadcast(top))  # one row
    part = F.when(F.col("v") == F.col("top"), 1.0).otherwise(F.exp((F.col("v") - F.col("top")) * base))
    out = df.groupBy(*keys).agg((F.max("top") + F.ln(F.sum(part)) / base).cast(by.result(t).spark).alias("v"), F.count(F.lit(1)).alias("n"))
    return out.where("n > 0").select(*keys, "v")


class Collection:
    KEYS: list[str] = []

    def __init__(self, df: DataFrame, dtype, shape: tuple):
        self.df, self.dtype, self.shape = df, dt.lookup(dtype), tuple(int(n) for n in shape)

    @classmethod
    def of(cls, df: DataFrame, dtype, shape: tuple):
        out = cls.__new__(cls)
        Collection.__init__(out, df, dtype, shape)
        return out

    @classmethod
    def _empty(cls, dtype, shape):
        t = dt.lookup(dtype)
        schema = T.StructType([*(T.StructField(k, T.LongType()) for k in cls.KEYS), T.StructField("v", t.spark)])
        return cls.of(session().createDataFrame([], schema), t, shape)

    @classmethod
    def from_df(cls, df: DataFrame, *cols, dtype=None, shape=None, dup_op=None, sparse=False):
        """From a DataFrame: the coordinate columns, then the value column or a constant.

        dup_op folds repeated coordinates in one aggregation; without it they are
        taken to be unique (``build`` checks). sparse says that few repeat: rows are then
        exchanged before they are folded, in as many partitions as the input has pieces.
        """
        *keys, v = [F.col(c) if isinstance(c, str) else c for c in cols] if len(cols) > len(cls.KEYS) else [*map(F.col, cols), F.lit(1.0)]
        if not isinstance(v, Column):
            v = F.lit(_plain(v))
        df = df.select(*(k.cast("long").alias(n) for k, n in zip(keys, cls.KEYS, strict=True)), v.alias("v"))
        src = dt.lookup(df.schema["v"].dataType)
        t = src if dtype is None else dt.lookup(dtype)
        df = df.withColumn("v", dt.cast(F.col("v"), src, t))
        if dup_op is not None:
            df = spread(df, pieces(df), *cls.KEYS) if sparse else df
            df = df.groupBy(*cls.KEYS).agg(ops.as_monoid(dup_op).reduce(F.col("v"), t).alias("v"))
        if shape is None:
            top = df.agg(*(F.max(k) for k in cls.KEYS)).first()
            if any(x is None for x in top):
                raise InvalidValue("a shape is needed for no entries")
            shape = tuple(int(x) + 1 for x in top)
        return cls.of(df, t, shape)

    # -------------------------------------------------------------- accessors

    @property
    def S(self) -> masks.Mask:
        return masks.Mask(self, False)

    @property
    def V(self) -> masks.Mask:
        return masks.Mask(self, True)

    @property
    def nvals(self) -> int:
        return self.df.count()

    def persist(self):
        self.df = self.df.persist()
        return self

    def wait(self):
        """Runs what is pending and keeps the rows in memory."""
        self.persist().df.count()
        return self

    def checkpoint(self):
        """Cuts the lineage, for loops: rows go to the session's checkpoint folder."""
        self.df = stored(self.df)
        return self

    def dup(self, dtype=None, *, clear: bool = False, mask=None, name=None):
        t = self.dtype if dtype is None else dt.lookup(dtype)
        if clear:
            return type(self)._empty(t, self.shape)
        df = self.df
        if mask is not None:
            df = masks.check(mask).keep(df)
        if t != self.dtype:
            df = df.withColumn("v", dt.cast(F.col("v"), self.dtype, t))
        return type(self).of(df, t, self.shape)

    def clear(self) -> None:
        self.df = type(self)._empty(self.dtype, self.shape).df

    def _sorted(self):
        return self.df.orderBy(*self.KEYS)

    def _pairs(self, other, tail: str = "full") -> DataFrame:
        """Both sides' rows by coordinate: keys, x, y and flags hx, hy."""
        a = self.df.select(*self.KEYS, F.col("v").alias("x"), F.lit(True).alias("hx"))
        b = other.df.select(*self.KEYS, F.col("v").alias("y"), F.lit(True).alias("hy"))
        return a.join(b, self.KEYS, tail)

    def isequal(self, other, *, check_dtype: bool = False) -> bool:
        """Same shape, coordinates and values."""
        other = other.new() if isinstance(other, Expr | Infix) else other
        if type(self) is not type(other) or self.shape != other.shape or (check_dtype and self.dtype != other.dtype):
            return False
        same = ops.BINARY["eq"].compute(F.col("x"), F.col("y"), self.dtype, other.dtype) if "o" not in (self.dtype.kind, other.dtype.kind) else F.col("x") == F.col("y")
        return not self._pairs(other).where(F.col("hx").isNull() | F.col("hy").isNull() | ~same).head(1)

    def isclose(self, other, *, rel_tol: float = 1e-7, abs_tol: float = 0.0, check_dtype: bool = False) -> bool:
        other = other.new() if isinstance(other, Expr | Infix) else other
        if type(self) is not type(other) or self.shape != other.shape or (check_dtype and self.dtype != other.dtype):
            return False
        near = ops.isclose(rel_tol, abs_tol).compute(F.col("x"), F.col("y"), self.dtype, other.dtype)
        return not self._pairs(other).where(F.col("hx").isNull() | F.col("hy").isNull() | ~near).head(1)

    # -------------------------------------------------------------- writing

    def __call__(self, *args, mask=None, accum=None, replace: bool = False, input_mask=None):
        mask, accum, replace = _args(args, mask, accum, replace)
        if replace and mask is None and input_mask is None:
            raise TypeError("replace needs a mask")
        return Updater(self, mask, accum, replace, input_mask)

    def __lshift__(self, expr):
        Updater(self, None, None, False) << expr
        return None

    update = __lshift__

    def _write(self, t: DataFrame, t_type, accum, mask, replace: bool, region: Column | None = None, sub: masks.Mask | None = None) -> None:
        """The write-back: this << t inside region, through mask and accumulator.

        One full outer join with presence flags, and one join for the mask; without
        mask, accumulator and region t itself, and with a replacing mask a semi join.
        """
        k = self.KEYS
        t = t.select(*k, dt.cast(F.col("v"), t_type, self.dtype).alias("v")) if accum is None else t.select(*k, "v")
        if accum is None and region is None and (mask is None or replace):
            self.df = t if mask is None else mask.keep(t)
            return
        c = self.df.select(*k, F.col("v").alias("x"), F.lit(True).alias("hx"))
        both = c.join(t.select(*k, F.col("v").alias("y"), F.lit(True).alias("hy")), k, "full") if k else c.crossJoin(t.select(F.col("v").alias("y"), F.lit(True).alias("hy")))
        hx, hy = F.col("hx").isNotNull(), F.col("hy").isNotNull()
        y = F.col("y") if accum is None else dt.cast(F.col("y"), t_type, self.dtype)
        if accum is None:
            z, hz = y, hy
        else:
            f = ops.as_binary(accum)
            res = dt.cast(f.compute(F.col("x"), F.col("y"), self.dtype, t_type), f.out(self.dtype, t_type), self.dtype)
            z, hz = F.when(hx & hy, res).when(hy, y).otherwise(F.col("x")), hx | hy
        if region is not None:
            z, hz = F.when(region, z).otherwise(F.col("x")), F.when(region, hz).otherwise(hx)
        use = sub or mask
        if use is not None:
            both = both.join(use.coords().withColumn("m", F.lit(True)), k, "left")
            inside = F.col("m").isNull() if use.complement else F.col("m").isNotNull()
            if sub is not None and region is not None:
                inside = inside | ~region
            z = F.when(inside, z).otherwise(F.col("x"))
            hz = F.when(inside, hz).otherwise(F.lit(False) if replace else hx)
        self.df = both.where(hz).select(*k, z.alias("v"))

    def _source(self, expr, mask, replace, accum):
        """(rows, type) of the right side; the mask goes into it where that changes nothing else."""
        if isinstance(expr, Updater):
            expr = expr._extract()
        if isinstance(expr, Infix):
            expr = expr._default()
        if isinstance(expr, Expr):
            if expr.kind is not type(self) or expr.shape != self.shape:
                raise DimensionMismatch(f"{expr!r} into shape {self.shape}")
            return expr.make(mask.keep if mask is not None and (replace or accum is None) else None), expr.dtype
        if isinstance(expr, Transposed):
            expr = expr.new()
        if isinstance(expr, masks.Mask):
            expr = expr.new()
        if isinstance(expr, Collection) and type(expr) is type(self):
            if expr.shape != self.shape:
                raise DimensionMismatch(f"shape {expr.shape} into {self.shape}")
            return expr.df, expr.dtype
        value = expr.value if isinstance(expr, Scalar) else expr
        t = dt.of_value(value) if self.dtype.kind != "o" else self.dtype
        t = dt.unify(self.dtype, t, weak=True) if self.dtype.kind != "o" else t
        rows = mask.coords() if mask is not None and not mask.complement else self.dense_coords()
        return rows.withColumn("v", dt.lit(value, t)), t

    # -------------------------------------------------------------- elementwise

    def _expr(self, dtype, make, name, shape=None, kind=None) -> Expr:
        return Expr(kind or type(self), dtype, self.shape if shape is None else shape, make, name)

    def _same_shape(self, other):
        if self.shape != other.shape:
            raise DimensionMismatch(f"{self.shape} and {other.shape}")

    def _coords(self) -> dict:
        i = F.col("i") if "i" in self.KEYS else F.lit(0)
        j = F.col("j") if "j" in self.KEYS else F.lit(0)
        return {"ix": i, "jx": j, "iy": i, "jy": j}

    def ewise_mult(self, other, op="times") -> Expr:
        """Entries that both sides have."""
        self, other = _both(self, other)
        f = _binary(op)
        t = f.out(self.dtype, other.dtype)
        if type(self) is not type(other):
            return _broadcast(self, other, f, "mult")
        self._same_shape(other)
        a, b = self, _copy(other)

        def make(keep):
            df = a._pairs(b, "inner")
            df = keep(df) if keep else df
            return df.select(*a.KEYS, f.compute(F.col("x"), F.col("y"), a.dtype, b.dtype, a._coords()).alias("v"))

        return self._expr(t, make, "ewise_mult")

    def ewise_add(self, other, op="plus") -> Expr:
        """Entries that either side has; where one is missing the other passes as it is."""
        self, other = _both(self, other)
        f = _binary(op)
        if type(self) is not type(other):
            return _broadcast(self, other, f, "add")
        self._same_shape(other)
        t = f.out(self.dtype, other.dtype)
        a, b = self, _copy(other)

        def make(keep):
            df = a._pairs(b)
            df = keep(df) if keep else df
            x, y = dt.cast(F.col("x"), a.dtype, t), dt.cast(F.col("y"), b.dtype, t)
            r = f.compute(F.col("x"), F.col("y"), a.dtype, b.dtype, a._coords())
            return df.select(*a.KEYS, F.when(F.col("hx") & F.col("hy"), r).when(F.col("hx"), x).otherwise(y).alias("v"))

        return self._expr(t, make, "ewise_add")

    def ewise_union(self, other, op, left_default, right_default) -> Expr:
        """Entries that either side has; a missing side has its default."""
        self, other = _both(self, other)
        f = _binary(op)
        ld, rd = (x.value if isinstance(x, Scalar) else x for x in (left_default, right_default))
        tx, ty = (c.dtype if c.dtype.kind == "o" else dt.unify(c.dtype, dt.of_value(d), weak=True) for c, d in ((self, ld), (other, rd)))
        if type(self) is not type(other):
            return _broadcast(self, other, f, "union", (ld, rd))
        self._same_shape(other)
        a, b = self, _copy(other)

        def make(keep):
            df = a._pairs(b)
            df = keep(df) if keep else df
            x = F.when(F.col("hx").isNotNull(), dt.cast(F.col("x"), a.dtype, tx)).otherwise(dt.lit(ld, tx))
            y = F.when(F.col("hy").isNotNull(), dt.cast(F.col("y"), b.dtype, ty)).otherwise(dt.lit(rd, ty))
            return df.select(*a.KEYS, f.compute(x, y, tx, ty, a._coords()).alias("v"))

        return self._expr(f.out(tx, ty), make, "ewise_union")

    def apply(self, op, right=None, *, left=None) -> Expr:
        """A function of each stored entry: unary, binary with one side bound, or of its place."""
        if left is not None and right is not None:
            raise TypeError("only one side can be bound")
        a = _copy(self)
        i, j = (a._coords()[k] for k in ("ix", "jx"))
        if isinstance(op, ops.IndexUnaryOp) or (isinstance(op, str) and op in ops.INDEXUNARY):
            f = ops.as_index(op)
            k = 0 if right is None else (right.value if isinstance(right, Scalar) else right)
            thunk = dt.lit(k, a.dtype if f.name.startswith("value") and a.dtype.kind != "o" else dt.of_value(k))
            return self._expr(f.result(a.dtype), _rows(a, lambda v: f.compute(v, a.dtype, i, j, thunk)), f"apply {f.name}")
        if left is None and right is None:
            f = ops.as_unary(op) if not isinstance(op, ops.BinaryOp | ops.Monoid) else None
            if f is None:
                raise TypeError("a binary operator needs left or right")
            return self._expr(f.result(a.dtype), _rows(a, lambda v: f.compute(v, a.dtype, i, j)), f"apply {f.name}")
        f = _binary(op)
        s = left if left is not None else right
        s = s.value if isinstance(s, Scalar) else s
        st = dt.of_value(s) if a.dtype.kind != "o" else a.dtype
        t = None
        if a.dtype.kind != "o" and not f.pinned and not f.positional and not f.meta.get("raw"):
            t = dt.unify(a.dtype, st, weak=True)
            st = t
        c = dt.lit(s, st)
        at = a._coords()
        if left is not None:
            return self._expr(f.out(st, a.dtype, t), _rows(a, lambda v: f.compute(c, v, st, a.dtype, at, t)), f"apply {f.name}")
        return self._expr(f.out(a.dtype, st, t), _rows(a, lambda v: f.compute(v, c, a.dtype, st, at, t)), f"apply {f.name}")

    def select(self, op, thunk=None) -> Expr:
        """Entries for which op holds; op may be a mask or a BOOL collection or expression."""
        a = _copy(self)
        if isinstance(op, Expr | Infix):
            op = op.new()
        if isinstance(op, Collection):
            op = masks.check(op)
        if isinstance(op, masks.Mask):
            return self._expr(a.dtype, lambda keep, m=op: _kept(m.keep(a.df), keep), "select mask")
        f = ops.as_index(op)
        if not f.is_select:
            raise TypeError(f"{f.name} does not select")
        k = 0 if thunk is None else (thunk.value if isinstance(thunk, Scalar) else thunk)
        at = a._coords()
        t = a.dtype if not f.name.startswith("value") or a.dtype.kind == "o" else dt.unify(a.dtype, dt.of_value(k), weak=True)
        c = dt.lit(k, t) if f.name.startswith("value") else F.lit(_plain(k))
        v = dt.cast(F.col("v"), a.dtype, t)
        return self._expr(a.dtype, lambda keep: _kept(a.df.where(f.compute(v, t, at["ix"], at["jx"], c)), keep), f"select {f.name}")

    def _reduce_all(self, op, allow_empty: bool = True) -> Expr:
        a = _copy(self)
        if (g := aggs.as_agg(op)) is not None:
            if g.name in ("argmin", "argmax", "first_index", "last_index") and len(a.KEYS) > 1:
                raise ValueError(f"{g.name} needs one axis")
            at = F.col("i") if len(a.KEYS) == 1 else F.struct(*a.KEYS)
            return Expr(Scalar, g.result(a.dtype), (), lambda keep: folded(a.df, [], g, a.dtype, at), g.name)
        m = ops.as_monoid(op)
        t = m.result(a.dtype)

        def make(keep):
            if allow_empty or m.name.startswith("logaddexp"):
                return folded(a.df, [], m, a.dtype)
            df = a.df.agg(m.reduce(F.col("v"), a.dtype).alias("v"), F.count(F.lit(1)).alias("n"))
            return df.select(F.when(F.col("n") > 0, F.col("v")).otherwise(dt.lit(m.identity(t), t)).alias("v"))

        return Expr(Scalar, t, (), make, m.name)

    # -------------------------------------------------------------- infix

    def __and__(self, other):
        return Infix("&", *_both(self, other))

    def __or__(self, other):
        return Infix("|", *_both(self, other))

    def __matmul__(self, other):
        other = other.new() if isinstance(other, Expr | Infix) else other
        return Infix("@", self, other)

    def __invert__(self):
        if self.dtype.kind != "b":
            raise TypeError("~ is for BOOL")
        return self.apply("lnot")

    def __neg__(self):
        return self.apply("ainv")

    def __abs__(self):
        return self.apply("abs")

    def __bool__(self):
        raise TypeError("a collection has no truth; use nvals or isequal")

    def __hash__(self):
        return id(self)

    #: Entries shown by repr.
    SHOWN = 8

    def _head(self) -> str:
        return f"{type(self).__name__}({self.dtype}, shape={self.shape})"

    def _sample(self) -> list[tuple]:
        """A few entries, and whether there are more; runs a job."""
        return [(*(r[k] for k in self.KEYS), _native(r.v)) for r in self.df.limit(self.SHOWN + 1).collect()]

    def __repr__(self) -> str:
        rows = self._sample()
        cells = [f"  {', '.join(map(str, r[:-1]))}: {r[-1]}" if len(r) > 1 else f"  {r[0]}" for r in rows[: self.SHOWN]]
        return "\n".join([self._head(), *cells, *(["  ..."] if len(rows) > self.SHOWN else [])])

    def _repr_html_(self) -> str:
        from html import escape

        rows = self._sample()
        body = "".join("<tr>" + "".join(f"<td>{escape(str(x))}</td>" for x in r) + "</tr>" for r in rows[: self.SHOWN])
        names = "".join(f"<th>{k}</th>" for k in (*self.KEYS, "value"))
        more = "<div>...</div>" if len(rows) > self.SHOWN else ""
        return f"<div><b>{escape(self._head())}</b><table><tr>{names}</tr>{body}</table>{more}</div>"

    def __reduce__(self):
        import pyarrow as pa

        table = self.df.toArrow()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return restored, (type(self), self.dtype.name, self.dtype.spark.json(), self.shape, sink.getvalue().to_pybytes())


def restored(kind: type, name: str, spark: str, shape: tuple, data: bytes):
    """A collection from what pickle keeps of it: its rows as an Arrow stream."""
    import json

    import pyarrow as pa

    t = dt.register(name, T.StructType.fromJson({"type": "struct", "fields": [{"name": "v", "type": json.loads(spark), "nullable": True, "metadata": {}}]})["v"].dataType)
    with pa.ipc.open_stream(data) as rows:
        table = rows.read_all()
    schema = T.StructType([*(T.StructField(k, T.LongType()) for k in kind.KEYS), T.StructField("v", t.spark)])
    return kind.of(session().createDataFrame(table, schema), t, shape)


def _copy(c):
    """The collection as it is now."""
    return type(c).of(c.df, c.dtype, c.shape) if not isinstance(c, Transposed) else c.new()


def _both(a, b):
    fix = lambda c: c.new() if isinstance(c, Expr | Infix | Transposed | Updater) else c
    a, b = fix(a), fix(b)
    if not isinstance(b, Collection):
        raise TypeError(f"not a collection: {b!r}")
    return _copy(a), _copy(b)


def _binary(op):
    return ops.as_binary(op)


def _rows(a, f):
    return lambda keep: _kept(a.df, keep).select(*a.KEYS, f(F.col("v")).alias("v"))


def _kept(df, keep):
    return keep(df) if keep else df


def _args(args, mask, accum, replace):
    for a in args:
        if isinstance(a, masks.Mask | Collection) or isinstance(a, Expr):
            mask = a
        else:
            accum = a
    mask = masks.check(mask.new() if isinstance(mask, Expr) else mask)
    return mask, accum, replace


def _broadcast(a, b, f, how, defaults=(None, None)) -> Expr:
    """A vector against a matrix: a right vector along rows (by column), a left one along columns (by row)."""
    mat, vec, key = (a, b, "j") if isinstance(b, Vector) else (b, a, "i")
    if vec.shape[0] != mat.shape[1 if key == "j" else 0]:
        raise DimensionMismatch(f"{a.shape} and {b.shape}")
    other = "i" if key == "j" else "j"
    vdf = vec.df.select(F.col("i").alias(key), "v")

    def make(keep):
        if how == "mult":
            m = mat.df.select("i", "j", F.col("v").alias("m")).join(vdf, key)
            x, y = (F.col("m"), F.col("v")) if key == "j" else (F.col("v"), F.col("m"))
            return _kept(m, keep).select("i", "j", f.compute(x, y, a.dtype, b.dtype, mat._coords()).alias("v"))
        n = mat.shape[0 if key == "j" else 1]
        if n * mat.shape[1 if key == "j" else 0] > MAX_DENSE and n * vec.nvals > MAX_DENSE:
            raise InvalidValue(f"{n} x {vec.nvals} cells would be filled")
        full = vdf.crossJoin(vdf.sparkSession.range(n).toDF(other)).select("i", "j", "v")
        dense = Matrix.of(full, vec.dtype, mat.shape)
        pair = (mat, dense) if key == "j" else (dense, mat)
        e = pair[0].ewise_add(pair[1], f) if how == "add" else pair[0].ewise_union(pair[1], f, *defaults)
        return e.make(keep)

    return Expr(Matrix, f.out(a.dtype, b.dtype), mat.shape, make, f"ewise_{how} broadcast")


for _n, _op, _how in (("add", "plus", "|"), ("sub", "minus", "u"), ("mul", "times", "&"), ("truediv", "truediv", "&"), ("floordiv", "floordiv", "&"), ("mod", "numpy_mod", "&"), ("pow", "pow", "&"),
                      ("lt", "lt", "&"), ("gt", "gt", "&"), ("le", "le", "&"), ("ge", "ge", "&"), ("eq", "eq", "&"), ("ne", "ne", "&"), ("xor", "lxor", "|")):

    def _infix(self, other, op=_op, how=_how):
        if isinstance(other, Updater):
            other = other.new()
        if isinstance(other, Collection | Expr | Infix | Transposed) and not isinstance(other, Scalar):
            if op == "lxor" and self.dtype.kind != "b":
                raise TypeError("^ is for BOOL")
            return self.ewise_union(other, op, 0, 0) if how == "u" else self.ewise_add(other, op) if how == "|" else self.ewise_mult(other, op)
        out = self.apply(op, right=other)
        if op in ("lt", "gt", "le", "ge", "eq", "ne"):
            out.compared = (_copy(self), op, other.value if isinstance(other, Scalar) else other)
        return out

    setattr(Collection, f"__{_n}__", _infix)
    if _n not in ("lt", "gt", "le", "ge", "eq", "ne"):
        setattr(Collection, f"__r{_n}__", lambda self, other, op=_op: self.apply(op, left=other))
        setattr(Collection, f"__i{_n}__", (lambda self, other: (Updater(self, None, "plus", False) << (other if isinstance(other, Collection | Expr) else self.apply("second", right=other)), self)[1]) if _n == "add" else (lambda self, other, op=_n: (self << getattr(self, f"__{op}__")(other), self)[1]))


def _inplace(name: str, op: str, how: str):
    def run(self, other):
        if isinstance(other, Updater):
            other = other.new()
        both = isinstance(other, Collection | Expr | Infix | Transposed) and not isinstance(other, Scalar)
        e = (getattr(self, how)(other, op) if both else self.apply(op, right=other))
        if e.dtype.kind != "b":
            raise TypeError(f"{name} is for BOOL")
        self << e
        return self

    return run


Collection.__iand__ = _inplace("&=", "land", "ewise_mult")
Collection.__ior__ = _inplace("|=", "lor", "ewise_add")
Collection.__imatmul__ = lambda self, other: (self << (self @ other), self)[1]
Collection.__divmod__ = lambda self, other: (self // other, self % other)
Collection.__rdivmod__ = lambda self, other: (other // self, other % self)


class Updater:
    """The left side ``C(mask, accum, replace)``, with or without indices."""

    def __init__(self, target, mask=None, accum=None, replace=False, input_mask=None, at=None, sub=False):
        self.target, self.mask, self.accum, self.replace, self.input_mask, self.at, self.sub = target, mask, accum, replace, input_mask, at, sub
        if isinstance(target, Scalar) and mask is not None:
            raise TypeError("a Scalar takes no mask")

    def __call__(self, *args, mask=None, accum=None, replace=False):
        """``C[I, J](mask)``: subassign."""
        return Updater(self.target, *_args(args, mask, accum, replace), None, self.at, True)

    def __getitem__(self, at):
        return Updater(self.target, self.mask, self.accum, self.replace, self.input_mask, at)

    def __setitem__(self, at, value):
        self[at] << value

    def __delitem__(self, at):
        self.target._assign(at, None, self.mask, None, self.replace, False)

    def __lshift__(self, expr):
        if self.at is not None:
            self.target._assign(self.at, expr, self.mask, self.accum, self.replace, self.sub)
            return
        mask = self.mask
        if self.input_mask is not None:
            if mask is not None:
                raise TypeError("mask and input_mask exclude each other")
            if not isinstance(expr, Updater):
                raise TypeError("input_mask is for C << A[I, J]")
            mask = expr._mask_of(masks.check(self.input_mask))
        if self.replace and mask is None:
            raise TypeError("replace needs a mask")
        t, t_type = self.target._source(expr, mask, self.replace, self.accum)
        self.target._write(t, t_type, self.accum, mask, self.replace)

    update = __lshift__

    # reading: C[I, J] is an expression until it is written to
    def _extract(self) -> Expr:
        if self.at is None:
            raise TypeError("C(mask, accum) is only written to")
        return self.target._extract(self.at)

    def _mask_of(self, input_mask: masks.Mask) -> masks.Mask:
        """A mask over what is read from, in the numbering of what is read."""
        if input_mask.shape != self.target.shape:
            raise DimensionMismatch(f"input_mask of {input_mask.shape} for {self.target.shape}")
        return masks.Mask(input_mask.parent[self.at].new(), input_mask.value, input_mask.complement)

    def new(self, dtype=None, *, mask=None, input_mask=None, name=None):
        if mask is not None and input_mask is not None:
            raise TypeError("mask and input_mask exclude each other")
        return self._extract().new(dtype, mask=masks.check(mask) if input_mask is None else self._mask_of(masks.check(input_mask)))

    def __getattr__(self, name):
        if name.startswith("_") or self.__dict__.get("at") is None:
            raise AttributeError(name)
        return getattr(self._extract(), name)


for _n in ("and", "or", "matmul", "add", "sub", "mul", "truediv", "floordiv", "mod", "pow", "xor", "lt", "gt", "le", "ge", "eq", "ne", "neg", "abs", "invert", "radd", "rsub", "rmul", "rtruediv", "rfloordiv", "rmod", "rpow", "divmod", "iter", "contains"):
    setattr(Updater, f"__{_n}__", lambda self, *a, _n=_n: getattr(self.new(), f"__{_n}__")(*a))
Updater.__hash__ = object.__hash__


class _Grid(Collection):
    """What Matrix and Vector share."""

    def __getitem__(self, at):
        return Updater(self, at=at)

    def __setitem__(self, at, value):
        self._assign(at, value, None, None, False, False)

    def __delitem__(self, at):
        self._assign(at, None, None, None, False, False)

    def _axes(self, at) -> list[Index]:
        at = at if isinstance(at, tuple) else (at,)
        if len(at) != len(self.KEYS):
            raise TypeError(f"{len(self.KEYS)} indices are needed")
        return [Index(x, n) for x, n in zip(at, self.shape, strict=True)]

    def dense_coords(self) -> DataFrame:
        n = math.prod(self.shape)
        if n > MAX_DENSE:
            raise InvalidValue(f"{n} cells would be filled")
        df = session().range(self.shape[0]).toDF("i")
        return df if len(self.KEYS) == 1 else df.crossJoin(session().range(self.shape[1]).toDF("j"))

    def _extract(self, at) -> Expr:
        a, axes = _copy(self), self._axes(at)
        shape = tuple(x.n for x in axes if not x.is_int)

        def make(keep):
            df = a.df
            for x, k in zip(axes, a.KEYS, strict=True):
                df = x.place(df, k)
            left = [k for x, k in zip(axes, a.KEYS, strict=True) if not x.is_int]
            df = df.select(*(F.col(k).alias(n) for k, n in zip(left, ("i", "j"), strict=False)), "v")
            return _kept(df, keep)

        return Expr((Scalar, Vector, Matrix)[len(shape)], a.dtype, shape, make, "extract")

    def _assign(self, at, value, mask, accum, replace, sub) -> None:
        axes = self._axes(at)
        region = F.lit(True)
        for x, k in zip(axes, self.KEYS, strict=True):
            region = region & x.inside(F.col(k))
        free = [(x, k) for x, k in zip(axes, self.KEYS, strict=True) if not x.is_int]
        fixed = [(x, k) for x, k in zip(axes, self.KEYS, strict=True) if x.is_int]

        def out(df):  # from the region's own numbering to this collection's
            for n, (_, k) in zip(("i", "j"), free, strict=False):
                df = df.withColumnRenamed(n, f"__{k}")
            for _, k in free:
                df = df.withColumnRenamed(f"__{k}", k)
            for x, k in free:
                df = x.restore(df, k)
            for x, k in fixed:
                df = df.withColumn(k, F.lit(x.start).cast("long"))
            return df

        own_mask = mask
        if mask is not None and (sub or (fixed and free and len(mask.shape) == len(free))):
            # subassign, or a row's or column's mask: in the region's numbering, and nothing outside it changes
            if len(mask.shape) != len(free):
                raise TypeError("the mask's rank is not the region's")
            df = out(mask.coords())
            own_mask = masks.Mask(type(self).of(df.select(*self.KEYS).withColumn("v", F.lit(True)), BOOL, self.shape), False, mask.complement)
            sub = True
        elif mask is not None and len(mask.shape) != len(self.KEYS):
            raise TypeError("the mask's rank is not the collection's")
        if isinstance(value, Expr | Infix | Transposed | Updater):
            value = value.new()
        if value is None or (isinstance(value, Scalar) and value.is_empty):
            t, tt = type(self)._empty(self.dtype, self.shape).df, self.dtype
        elif isinstance(value, Collection) and not isinstance(value, Scalar):
            if value.shape != tuple(x.n for x, _ in free):
                raise DimensionMismatch(f"{value.shape} into {tuple(x.n for x, _ in free)}")
            t, tt = out(value.df).select(*self.KEYS, "v"), value.dtype
        elif isinstance(value, np.ndarray | list | tuple) and self.dtype.kind != "o":
            v = np.asarray(value)
            whole = (Vector if v.ndim == 1 else Matrix).from_dense(v)
            self._assign(at, whole, mask, accum, replace, sub)
            return
        else:
            value = value.value if isinstance(value, Scalar) else value
            tt = self.dtype if self.dtype.kind == "o" else dt.unify(self.dtype, dt.of_value(value), weak=True)
            if own_mask is not None and not own_mask.complement:
                rows = own_mask.coords().where(region)
            else:
                if math.prod(x.n for x in axes) > MAX_DENSE:
                    raise InvalidValue("the assignment would fill too many cells")
                rows = None
                for x, k in zip(axes, self.KEYS, strict=True):
                    part = x.listed(session(), k)
                    rows = part if rows is None else rows.crossJoin(part)
            t = rows.withColumn("v", dt.lit(value, tt))
        if sub:
            self._write(t, tt, accum, None, replace, region, own_mask)
        else:
            self._write(t, tt, accum, own_mask, replace, region)

    def __contains__(self, at) -> bool:
        return self[at].new().nvals > 0

    def __array__(self, *a, **k):
        raise TypeError("to_dense or to_coo gives arrays")

    def get(self, *at, default=None):
        v = self._extract(at if len(at) > 1 else at[0]).new().value
        return default if v is None else v

    def resize(self, *shape) -> None:
        keep = F.lit(True)
        for k, n in zip(self.KEYS, shape, strict=True):
            keep = keep & (F.col(k) < n)
        self.df, self.shape = self.df.where(keep), tuple(shape)

    @classmethod
    def _build(cls, coords, values, dtype, shape, dup_op):
        """From sequences or arrays: Arrow to rows, with the duplicate policy."""
        import pandas as pd

        coords = [np.asarray(c, dtype=np.int64) if np.size(c) else np.zeros(0, np.int64) for c in coords]
        n = len(coords[0])
        if any(len(c) != n for c in coords):
            raise InvalidValue("coordinates of different lengths")
        scalar = np.ndim(values) == 0 and not isinstance(values, list)
        if dtype is None:
            t = dt.of_value(values) if scalar else (dt.lookup(np.asarray(values).dtype) if not (len(values) and isinstance(values[0], dict)) else dt.of_value(values[0]))
        else:
            t = dt.lookup(dtype)
        if shape is None:
            if not n:
                raise InvalidValue("a shape is needed for no entries")
            shape = tuple(int(c.max()) + 1 for c in coords)
        for c, s in zip(coords, shape, strict=True):
            if n and (c.min() < 0 or c.max() >= s):
                raise IndexOutOfBound(f"index out of {s}")
        if scalar:
            if dup_op is not None:
                raise InvalidValue("one value for all entries takes no dup_op")
            df = session().createDataFrame(pd.DataFrame(dict(zip(cls.KEYS, coords, strict=True))), ", ".join(f"{k} long" for k in cls.KEYS)) if n else cls._empty(t, shape).df.select(*cls.KEYS)
            return cls.of(df.distinct().withColumn("v", dt.lit(values, t)), t, shape)
        if len(values) != n:
            raise InvalidValue("values and coordinates of different lengths")
        if not n:
            return cls._empty(t, shape)
        if dup_op is None and len(set(zip(*(c.tolist() for c in coords), strict=True))) != n:
            raise InvalidValue("duplicate coordinates without dup_op")
        src = t if t.kind in "oc" else dt.lookup(np.asarray(values).dtype)
        if src.kind in "oc" or src == dt.UINT64:
            conv = (lambda v: {"re": complex(v).real, "im": complex(v).imag}) if src.kind == "c" else (lambda v: __import__("decimal").Decimal(int(v))) if src == dt.UINT64 else (lambda v: np.ravel(v).tolist() if isinstance(src.spark, T.ArrayType) else v if isinstance(v, dict) else tuple(v))
            schema = T.StructType([*(T.StructField(k, T.LongType()) for k in cls.KEYS), T.StructField("v", src.spark)])
            df = session().createDataFrame([(*(int(x) for x in p[:-1]), conv(p[-1])) for p in zip(*coords, values, strict=True)], schema)
        else:
            import pyarrow as pa

            schema = T.StructType([*(T.StructField(k, T.LongType()) for k in cls.KEYS), T.StructField("v", src.spark)])
            arrow = {"b": pa.bool_(), "f": pa.float32() if src.bits == 32 else pa.float64()}.get(src.kind) or {8: pa.int16() if src.kind == "u" else pa.int8(), 16: pa.int32() if src.kind == "u" else pa.int16(), 32: pa.int64() if src.kind == "u" else pa.int32(), 64: pa.int64()}[src.bits]
            vals = pa.array(np.asarray(values)).cast(arrow)
            df = session().createDataFrame(pa.table([*(pa.array(c) for c in coords), vals], names=[*cls.KEYS, "v"]), schema)
        df = df.withColumn("v", dt.cast(F.col("v"), src, t))
        if dup_op is not None:
            m = ops.as_monoid(dup_op) if not callable(dup_op) or isinstance(dup_op, ops.Op | ops.Monoid) else ops.register_monoid(None, dup_op, 0)
            df = df.groupBy(*cls.KEYS).agg(m.reduce(F.col("v"), t).alias("v"))
        return cls.of(df, t, shape)

    def _fill(self, coords, values, dup_op, clear, shape) -> None:
        if not clear and self.df.head(1):
            raise OutputNotEmpty("build into a collection with entries")
        new = type(self)._build(coords, values, self.dtype, shape or self.shape, dup_op)
        self.df, self.shape = new.df, new.shape


class Vector(_Grid):
    KEYS = ["i"]

    def __init__(self, dtype=FP64, size: int = 0, *, name=None):
        Collection.__init__(self, Vector._empty(dtype, (size,)).df, dtype, (size,))

    @property
    def size(self) -> int:
        return self.shape[0]

    @classmethod
    def from_coo(cls, indices, values=1.0, dtype=None, *, size=None, dup_op=None, name=None):
        return cls._build([indices], values, dtype, None if size is None else (size,), dup_op)

    @classmethod
    def from_pairs(cls, pairs, dtype=None, *, size=None, dup_op=None, name=None):
        i, v = zip(*pairs, strict=True) if pairs else ((), ())
        return cls.from_coo(i, list(v), dtype, size=size, dup_op=dup_op)

    @classmethod
    def from_dict(cls, d, dtype=None, *, size=None, name=None):
        return cls.from_coo(list(d), list(d.values()), dtype, size=size)

    @classmethod
    def from_scalar(cls, value, size, dtype=None, *, name=None):
        value = value.value if isinstance(value, Scalar) else value
        t = dt.of_value(value) if dtype is None else dt.lookup(dtype)
        return cls.of(cls.of(None, t, (size,)).dense_coords().withColumn("v", dt.lit(value, t)), t, (size,))

    @classmethod
    def from_dense(cls, values, missing_value=None, *, dtype=None, name=None):
        v = np.asarray(values)
        at = np.arange(len(v)) if missing_value is None else np.flatnonzero(v != missing_value)
        return cls.from_coo(at, v[at], dtype, size=len(v))

    def build(self, indices, values, *, dup_op=None, clear=False, size=None):
        self._fill([indices], values, dup_op, clear, None if size is None else (size,))

    def to_coo(self, dtype=None, *, indices=True, values=True, sort=True):
        rows = (self._sorted() if sort else self.df).collect()
        i = np.array([r.i for r in rows], np.uint64) if indices else None
        return i, (_values(rows, dt.lookup(dtype or self.dtype)) if values else None)

    def to_dict(self) -> dict:
        return {r.i: _native(r.v) for r in self._sorted().collect()}

    def to_dense(self, fill_value=None, dtype=None):
        i, v = self.to_coo()
        if fill_value is None and len(i) != self.size:
            raise TypeError("fill_value is needed where entries are missing")
        out = np.full(self.size, 0 if fill_value is None else fill_value, np.result_type(v, type(fill_value)) if fill_value is not None else v.dtype)
        out[i.astype(int)] = v
        return out if dtype is None else out.astype(dt.numpy_of(dt.lookup(dtype)))

    def __iter__(self):
        return (r.i for r in self.df.select("i").orderBy("i").toLocalIterator())

    def _matmul(self, other, s):
        return self.inner(other, s) if isinstance(other, Vector) else self.vxm(other, s)

    def vxm(self, other, op="plus_times") -> Expr:
        other = other.new() if isinstance(other, Transposed) else other
        if self.size != other.shape[0]:
            raise DimensionMismatch(f"{self.shape} @ {other.shape}")
        s, u, a = ops.as_semiring(op), _copy(self), _copy(other)

        def make(keep):
            x = u.df.select(F.col("i").alias("k"), F.col("v").alias("x"))
            y = a.df.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
            df = x.join(y, "k").select("k", F.col("j").alias("i"), "x", "y")
            return _multiply(df, keep, s, u.dtype, a.dtype, ["i"], {"ix": F.lit(0), "jx": F.col("k"), "iy": F.col("k"), "jy": F.col("i")})

        return Expr(Vector, s.out(u.dtype, a.dtype), (a.shape[1],), make, f"vxm {s.name}")

    def inner(self, other, op="plus_times") -> Expr:
        if self.shape != other.shape:
            raise DimensionMismatch(f"{self.shape} @ {other.shape}")
        s, u, w = ops.as_semiring(op), _copy(self), _copy(other)

        def make(keep):
            z = s.binaryop.compute(F.col("x"), F.col("y"), u.dtype, w.dtype, u._coords())
            df = u._pairs(w, "inner").select(z.alias("v"))
            return folded(df, [], s.monoid, s.binaryop.out(u.dtype, w.dtype))

        return Expr(Scalar, s.out(u.dtype, w.dtype), (), make, f"inner {s.name}")

    def outer(self, other, op="times") -> Expr:
        f, u, w = _binary(op), _copy(self), _copy(other)

        def make(keep):
            df = _scattered(u.df.select("i", F.col("v").alias("x"))).crossJoin(w.df.select(F.col("i").alias("j"), F.col("v").alias("y")))
            return _kept(df, keep).select("i", "j", f.compute(F.col("x"), F.col("y"), u.dtype, w.dtype, {"ix": F.col("i"), "jx": F.lit(0), "iy": F.col("j"), "jy": F.lit(0)}).alias("v"))

        return Expr(Matrix, f.out(u.dtype, w.dtype), (u.size, w.size), make, f"outer {f.name}")

    def reduce(self, op="plus", *, allow_empty=True) -> Expr:
        return self._reduce_all(op, allow_empty)

    def diag(self, k: int = 0, *, name=None) -> Matrix:
        n = self.size + abs(k)
        df = self.df.select((F.col("i") + max(0, -k)).alias("i"), (F.col("i") + max(0, k)).alias("j"), "v")
        return Matrix.of(df, self.dtype, (n, n))

    def reposition(self, offset: int, *, size=None) -> Expr:
        a, n = _copy(self), self.size if size is None else size
        return Expr(Vector, a.dtype, (n,), lambda keep: _kept(a.df.select((F.col("i") + offset).alias("i"), "v").where(F.col("i").between(0, n - 1)), keep), "reposition")

    def as_matrix(self) -> Matrix:
        return Matrix.of(self.df.select("i", F.lit(0).cast("long").alias("j"), "v"), self.dtype, (self.size, 1))

    @property
    def ss(self):
        from lattica.operators.ext import VectorExt

        return VectorExt(self)


class Matrix(_Grid):
    KEYS = ["i", "j"]

    def __init__(self, dtype=FP64, nrows: int = 0, ncols: int = 0, *, name=None):
        Collection.__init__(self, Matrix._empty(dtype, (nrows, ncols)).df, dtype, (nrows, ncols))

    nrows = property(lambda self: self.shape[0])
    ncols = property(lambda self: self.shape[1])

    @property
    def T(self) -> Transposed:
        return Transposed(self)

    @classmethod
    def from_coo(cls, rows, columns, values=1.0, dtype=None, *, nrows=None, ncols=None, dup_op=None, name=None):
        shape = None
        if nrows is not None or ncols is not None:
            shape = (nrows if nrows is not None else int(np.max(rows)) + 1, ncols if ncols is not None else int(np.max(columns)) + 1)
        return cls._build([rows, columns], values, dtype, shape, dup_op)

    @classmethod
    def from_edgelist(cls, edges, values=None, dtype=None, *, nrows=None, ncols=None, dup_op=None, name=None):
        edges = list(edges)
        if edges and len(edges[0]) == 3 and values is None:
            values = [e[2] for e in edges]
        return cls.from_coo([e[0] for e in edges], [e[1] for e in edges], 1.0 if values is None else values, dtype, nrows=nrows, ncols=ncols, dup_op=dup_op)

    @classmethod
    def from_dicts(cls, d, dtype=None, *, order="rowwise", nrows=None, ncols=None, name=None):
        items = [(a, b, v) for a, row in (d.items() if isinstance(d, dict) else enumerate(d)) for b, v in row.items()]
        if order.lower().startswith(("c", "f")) and order.lower() != "c":
            items = [(b, a, v) for a, b, v in items]
        return cls.from_edgelist(items, dtype=dtype, nrows=nrows, ncols=ncols)

    @classmethod
    def from_csr(cls, indptr, indices, values=1.0, dtype=None, *, ncols=None, name=None):
        n = len(indptr) - 1
        return cls.from_coo(np.repeat(np.arange(n), np.diff(np.asarray(indptr, np.int64))), indices, values, dtype, nrows=n, ncols=ncols)

    @classmethod
    def from_csc(cls, indptr, indices, values=1.0, dtype=None, *, nrows=None, name=None):
        n = len(indptr) - 1
        return cls.from_coo(indices, np.repeat(np.arange(n), np.diff(np.asarray(indptr, np.int64))), values, dtype, nrows=nrows, ncols=n)

    @classmethod
    def from_dcsr(cls, compressed_rows, indptr, indices, values=1.0, dtype=None, *, nrows=None, ncols=None, name=None):
        return cls.from_coo(np.repeat(compressed_rows, np.diff(np.asarray(indptr, np.int64))), indices, values, dtype, nrows=nrows, ncols=ncols)

    @classmethod
    def from_dcsc(cls, compressed_cols, indptr, indices, values=1.0, dtype=None, *, nrows=None, ncols=None, name=None):
        return cls.from_coo(indices, np.repeat(compressed_cols, np.diff(np.asarray(indptr, np.int64))), values, dtype, nrows=nrows, ncols=ncols)

    @classmethod
    def from_scalar(cls, value, nrows, ncols, dtype=None, *, name=None):
        value = value.value if isinstance(value, Scalar) else value
        t = dt.of_value(value) if dtype is None else dt.lookup(dtype)
        return cls.of(cls.of(None, t, (nrows, ncols)).dense_coords().withColumn("v", dt.lit(value, t)), t, (nrows, ncols))

    @classmethod
    def from_dense(cls, values, missing_value=None, *, dtype=None, name=None):
        v = np.asarray(values)
        keep = np.ones(v.shape, bool) if missing_value is None else v != missing_value
        i, j = np.nonzero(keep)
        return cls.from_coo(i, j, v[keep], dtype, nrows=v.shape[0], ncols=v.shape[1])

    def build(self, rows, columns, values, *, dup_op=None, clear=False, nrows=None, ncols=None):
        self._fill([rows, columns], values, dup_op, clear, (nrows, ncols) if nrows is not None else None)

    def to_coo(self, dtype=None, *, rows=True, columns=True, values=True, sort=True):
        got = (self._sorted() if sort else self.df).collect()
        i, j = (np.array([getattr(r, k) for r in got], np.uint64) for k in "ij")
        return (i if rows else None), (j if columns else None), (_values(got, dt.lookup(dtype or self.dtype)) if values else None)

    def to_edgelist(self, dtype=None, *, values=True, sort=True):
        i, j, v = self.to_coo(dtype, sort=sort)
        return np.stack([i, j], axis=1), (v if values else None)

    def to_dicts(self, order="rowwise") -> dict:
        out: dict = {}
        for r in self._sorted().collect():
            a, b = (r.i, r.j) if order == "rowwise" else (r.j, r.i)
            out.setdefault(a, {})[b] = _native(r.v)
        return out

    def _compressed(self, by_row: bool, hyper: bool):
        i, j, v = self.to_coo()
        if not by_row:
            o = np.lexsort((i, j))
            i, j, v = j[o], i[o], v[o]
        n = self.shape[0 if by_row else 1]
        if hyper:
            own, counts = np.unique(i, return_counts=True)
            return own, np.concatenate([[0], np.cumsum(counts)]).astype(np.uint64), j, v
        return np.concatenate([[0], np.cumsum(np.bincount(i.astype(int), minlength=n))]).astype(np.uint64), j, v

    def to_csr(self, dtype=None):
        return self._compressed(True, False)

    def to_csc(self, dtype=None):
        return self._compressed(False, False)

    def to_dcsr(self, dtype=None):
        return self._compressed(True, True)

    def to_dcsc(self, dtype=None):
        return self._compressed(False, True)

    def to_dense(self, fill_value=None, dtype=None):
        i, j, v = self.to_coo()
        if fill_value is None and len(i) != self.nrows * self.ncols:
            raise TypeError("fill_value is needed where entries are missing")
        out = np.full(self.shape, 0 if fill_value is None else fill_value, np.result_type(v, type(fill_value)) if fill_value is not None else v.dtype)
        out[i.astype(int), j.astype(int)] = v
        return out if dtype is None else out.astype(dt.numpy_of(dt.lookup(dtype)))

    def __iter__(self):
        return ((r.i, r.j) for r in self.df.select("i", "j").orderBy("i", "j").toLocalIterator())

    def _matmul(self, other, s):
        return self.mxv(other, s) if isinstance(other, Vector) else self.mxm(other, s)

    def mxm(self, other, op="plus_times") -> Expr:
        """Join on the inner index, then one aggregation.

        It has map-side parts where the shape bounds them; else the products are exchanged
        first, as a table of parts that hardly repeat would fill a task's memory. The join then has as
        many partitions as that exchange: a task holds the products that it writes to over DIRECT of them. Hubs
        are counted out and met in cells.
        A mask reaches below the aggregation, and a plain one below the join: rows of A and columns of B
        that it does not have are dropped first.
        """
        other = other.new() if isinstance(other, Transposed | Expr | Infix) else other
        if self.ncols != other.nrows:
            raise DimensionMismatch(f"{self.shape} @ {other.shape}")
        s, a, b = ops.as_semiring(op), _copy(self), _copy(other)

        def make(keep):
            x = a.df.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
            y = b.df.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
            m = getattr(keep, "__self__", None)
            if m is not None and not m.complement:
                x = x.join(m.coords().select("i").distinct(), "i", "left_semi")
                y = y.join(m.coords().select("j").distinct(), "j", "left_semi")
            n = pieces(a.df, b.df) if keep is None and a.nrows * b.ncols > SMALL_SHAPE else 0
            return _multiply(met(x, y, n), keep, s, a.dtype, b.dtype, ["i", "j"], {"ix": F.col("i"), "jx": F.col("k"), "iy": F.col("k"), "jy": F.col("j")}, n)

        return Expr(Matrix, s.out(a.dtype, b.dtype), (a.nrows, b.ncols), make, f"mxm {s.name}")

    def mxv(self, other, op="plus_times") -> Expr:
        if self.ncols != other.size:
            raise DimensionMismatch(f"{self.shape} @ {other.shape}")
        s, a, u = ops.as_semiring(op), _copy(self), _copy(other)

        def make(keep):
            x = a.df.select("i", F.col("j").alias("k"), F.col("v").alias("x"))
            y = u.df.select(F.col("i").alias("k"), F.col("v").alias("y"))
            return _multiply(x.join(y, "k"), keep, s, a.dtype, u.dtype, ["i"], {"ix": F.col("i"), "jx": F.col("k"), "iy": F.col("k"), "jy": F.lit(0)})

        return Expr(Vector, s.out(a.dtype, u.dtype), (a.nrows,), make, f"mxv {s.name}")

    def kronecker(self, other, op="times") -> Expr:
        other = other.new() if isinstance(other, Transposed) else other
        f, a, b = _binary(op), _copy(self), _copy(other)

        def make(keep):
            df = _scattered(a.df.select(F.col("i").alias("ai"), F.col("j").alias("aj"), F.col("v").alias("x"))).crossJoin(b.df.select(F.col("i").alias("bi"), F.col("j").alias("bj"), F.col("v").alias("y")))
            at = {"ix": F.col("ai"), "jx": F.col("aj"), "iy": F.col("bi"), "jy": F.col("bj")}
            v = f.compute(F.col("x"), F.col("y"), a.dtype, b.dtype, at)
            return _kept(df.select((F.col("ai") * b.nrows + F.col("bi")).alias("i"), (F.col("aj") * b.ncols + F.col("bj")).alias("j"), v.alias("v")), keep)

        return Expr(Matrix, f.out(a.dtype, b.dtype), (a.nrows * b.nrows, a.ncols * b.ncols), make, f"kronecker {f.name}")

    def power(self, n: int, op="plus_times") -> Expr:
        """By repeated squaring; n = 0 is the diagonal of the multiplier's identity."""
        if self.nrows != self.ncols:
            raise DimensionMismatch("power of a matrix that is not square")
        if n < 0:
            raise ValueError("n must not be negative")
        s, a = ops.as_semiring(op), _copy(self)
        if not n:
            if s.binaryop.monoid is None:
                raise ValueError(f"{s.binaryop.name} has no identity")
            one = Vector.from_scalar(s.binaryop.monoid.identity(a.dtype), a.nrows, dtype=a.dtype).diag()
            return Expr(Matrix, a.dtype, a.shape, lambda keep: _kept(one.df, keep), "power 0")

        def make(keep):
            out, square, left = None, a, n
            while left:
                if left & 1:
                    out = square if out is None else out.mxm(square, s).new()
                left >>= 1
                if left:
                    square = square.mxm(square, s).new()
                    if left > 2:
                        square.checkpoint()
            return _kept(out.df, keep)

        return Expr(Matrix, s.out(a.dtype, a.dtype) if n > 1 else a.dtype, a.shape, make, f"power {n}")

    def _reduce_axis(self, op, key: str) -> Expr:
        a = _copy(self)
        other, n = ("j", a.nrows) if key == "i" else ("i", a.ncols)
        g = aggs.as_agg(op)
        by = ops.as_monoid(op) if g is None else g

        def make(keep):
            df = a.df.select(F.col(key).alias("i"), F.col(other).alias("at"), "v")
            return folded(_kept(df, keep), ["i"], by, a.dtype, None if g is None else F.col("at"))

        return Expr(Vector, by.result(a.dtype), (n,), make, "reduce")

    def reduce_rowwise(self, op="plus") -> Expr:
        return self._reduce_axis(op, "i")

    def reduce_columnwise(self, op="plus") -> Expr:
        return self._reduce_axis(op, "j")

    def reduce_scalar(self, op="plus", *, allow_empty=True) -> Expr:
        return self._reduce_all(op, allow_empty)

    def diag(self, k: int = 0, *, dtype=None, name=None) -> Vector:
        n = max(0, min(self.nrows, self.ncols - k) if k >= 0 else min(self.nrows + k, self.ncols))
        df = self.df.where(F.col("j") - F.col("i") == k).select(F.least("i", "j").alias("i"), "v")
        out = Vector.of(df, self.dtype, (n,))
        return out if dtype is None else out.dup(dtype)

    def setdiag(self, values, k: int = 0, *, mask=None, accum=None) -> None:
        n = max(0, min(self.nrows, self.ncols - k) if k >= 0 else min(self.nrows + k, self.ncols))
        if not n:
            raise IndexOutOfBound(f"diagonal {k} of {self.shape}")
        if isinstance(values, Expr):
            values = values.new()
        if not isinstance(values, Vector):
            values = Vector.from_dense(np.asarray(values)) if np.ndim(values) else Vector.from_scalar(values, n, dtype=dt.unify(self.dtype, dt.of_value(values.value if isinstance(values, Scalar) else values), weak=True))
        if values.size != n:
            raise DimensionMismatch(f"diagonal of {n} from {values.size}")
        put = lambda df: df.select((F.col("i") + max(0, -k)).alias("i"), (F.col("i") + max(0, k)).alias("j"), *(["v"] if "v" in df.columns else []))
        m = masks.check(mask)
        if m is not None and len(m.shape) == 1:
            m = masks.Mask(Matrix.of(put(m.coords()).withColumn("v", F.lit(True)), BOOL, self.shape), False, m.complement)
        self._write(put(values.df), values.dtype, accum, None, False, F.col("j") - F.col("i") == k, m)

    def reposition(self, row_offset: int, column_offset: int, *, nrows=None, ncols=None) -> Expr:
        a, n, m = _copy(self), self.nrows if nrows is None else nrows, self.ncols if ncols is None else ncols
        df = a.df.select((F.col("i") + row_offset).alias("i"), (F.col("j") + column_offset).alias("j"), "v").where(F.col("i").between(0, n - 1) & F.col("j").between(0, m - 1))
        return Expr(Matrix, a.dtype, (n, m), lambda keep: _kept(df, keep), "reposition")

    @property
    def ss(self):
        from lattica.operators.ext import MatrixExt

        return MatrixExt(self)


def _scattered(df) -> DataFrame:
    """The left side of a cross join in more partitions than there are cores: a small file is one, and all pairs would be made there."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *df.columns)


def _multiply(df, keep, s, tx, ty, keys, at, n: int = 0) -> DataFrame:
    df = df.select(*keys, s.binaryop.compute(F.col("x"), F.col("y"), tx, ty, at).alias("v"))
    df = keep(df) if keep else spread(df, n, *keys)
    return folded(df, keys, s.monoid, s.binaryop.out(tx, ty))


class Transposed:
    """The read-only view A.T: a projection, no shuffle."""

    def __init__(self, parent: Matrix):
        self._parent = parent
        self.dtype, self.shape = parent.dtype, parent.shape[::-1]

    @property
    def T(self) -> Matrix:
        return self._parent

    def new(self, dtype=None, *, mask=None, name=None) -> Matrix:
        p = self._parent
        out = Matrix.of(p.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"), p.dtype, self.shape)
        return out if dtype is None and mask is None else out.dup(dtype, mask=mask)

    dup = new

    def __getattr__(self, name):
        if name.startswith("_"):
            raise AttributeError(name)
        return getattr(self.new(), name)

    def __setitem__(self, at, value):
        raise TypeError("A.T is read-only")

    def __lshift__(self, expr):
        raise TypeError("A.T is read-only")


for _n in ("__and__", "__or__", "__matmul__", "__add__", "__sub__", "__mul__", "__truediv__", "__getitem__", "__contains__", "__iter__", "__neg__", "__abs__", "__invert__", "__lt__", "__gt__", "__le__", "__ge__", "__pow__", "__mod__", "__floordiv__"):
    setattr(Transposed, _n, lambda self, *a, _n=_n: getattr(self.new(), _n)(*a))


class Scalar(Collection):
    """At most one value, as a DataFrame of at most one row; read when asked for."""

    def __init__(self, dtype=FP64, *, is_cscalar: bool = False, name=None):
        Collection.__init__(self, Scalar._empty(dtype, ()).df, dtype, ())
        self.is_cscalar = is_cscalar

    @classmethod
    def from_value(cls, value, dtype=None, *, is_cscalar: bool = False, name=None):
        if isinstance(value, Scalar):
            return value.dup(dtype)
        if value is None:
            return cls._empty(dtype or FP64, ())
        t = dt.of_value(value) if dtype is None else dt.lookup(dtype)
        return cls.of(session().range(1).select(dt.lit(value, t).alias("v")), t, ())

    @property
    def value(self):
        r = self.df.head(1)
        return _native(r[0].v) if r else None

    @value.setter
    def value(self, v):
        self.df = Scalar.from_value(v, self.dtype).df

    @property
    def is_empty(self) -> bool:
        return not self.df.head(1)

    def get(self, default=None):
        v = self.value
        return default if v is None else v

    def __lshift__(self, expr):
        Updater(self, None, None, False) << expr

    def _source(self, expr, mask, replace, accum):
        if isinstance(expr, Updater):
            expr = expr._extract()
        if isinstance(expr, Infix):
            expr = expr._default()
        if isinstance(expr, Expr):
            return expr.make(None), expr.dtype
        if isinstance(expr, Scalar):
            return expr.df, expr.dtype
        s = Scalar.from_value(expr, dt.unify(self.dtype, dt.of_value(expr), weak=True))
        return s.df, s.dtype

    def _write(self, t, t_type, accum, mask, replace, region=None, sub=None):
        if accum is None:
            self.df = t.select(dt.cast(F.col("v"), t_type, self.dtype).alias("v"))
            return
        a = self.df.select(F.lit(0).alias("z"), F.col("v").alias("x"), F.lit(True).alias("hx"))
        b = t.select(F.lit(0).alias("z"), F.col("v").alias("y"), F.lit(True).alias("hy"))
        f = ops.as_binary(accum)
        r = dt.cast(f.compute(F.col("x"), F.col("y"), self.dtype, t_type), f.out(self.dtype, t_type), self.dtype)
        self.df = a.join(b, "z", "full").select(F.when(F.col("hx") & F.col("hy"), r).when(F.col("hx"), F.col("x")).otherwise(dt.cast(F.col("y"), t_type, self.dtype)).alias("v"))

    def _pairs(self, other, tail="full"):
        a = self.df.select(F.lit(0).alias("z"), F.col("v").alias("x"), F.lit(True).alias("hx"))
        b = other.df.select(F.lit(0).alias("z"), F.col("v").alias("y"), F.lit(True).alias("hy"))
        return a.join(b, "z", tail)

    def __eq__(self, other):
        if other is None:
            return self.is_empty
        return self.isequal(other if isinstance(other, Scalar) else Scalar.from_value(other))

    def __bool__(self):
        return bool(self.value)

    def __int__(self):
        return int(self.value)

    __index__ = __int__

    def __float__(self):
        return float(self.value)

    def __complex__(self):
        return complex(self.value)

    def __array__(self, dtype=None):
        return np.array(self.value, dtype)

    def __hash__(self):
        return id(self)


def _native(v):
    if isinstance(v, Row) and set(v.asDict()) == {"re", "im"}:
        return complex(v.re, v.im)
    if isinstance(v, Row):
        return v.asDict()
    return int(v) if type(v).__name__ == "Decimal" else v


def _values(rows, t):
    vals = [_native(r.v) for r in rows]
    n = dt.numpy_of(t)
    return np.array(vals, n) if n != object else vals
