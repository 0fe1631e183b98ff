"""Scans, sorts, top-k, packing, reshaping and tiles of stored entries.

Scans and vector sorts range-partition the stored entries by their order and write them
once (``ranged``): Spark's sampled ranges hold about equally many entries, however they
are spread over the shape, so a hot row or a clustered vector takes many tasks. Each
range is scanned alone, the few totals of the ranges are scanned after that, and the
totals before a range are joined to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.exceptions import DimensionMismatch, InvalidValue, NotImplementedException
from lattica.functions import ops
from lattica.functions.dtypes import INT64
from lattica.functions import dtypes as dt
from lattica.operators.collection import Matrix, Scalar, Vector, fixed, folded


def ranged(df: DataFrame, *order) -> DataFrame:
    """df in ranges of the order, with range p and row number m that grow along it; written once, so both stay as they are."""
    return fixed(df.orderBy(*order).withColumn("p", F.spark_partition_id()).withColumn("m", F.monotonically_increasing_id()))


def ranked(df: DataFrame, *order) -> DataFrame:
    """df with r: each row's place in the order, from 1."""
    df = ranged(df, *order)
    n = df.groupBy("p").agg(F.count(F.lit(1)).alias("c"), F.min("m").alias("lo"))  # a row per range
    start = n.withColumn("s", F.coalesce(F.sum("c").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return df.join(F.broadcast(start), "p").withColumn("r", F.col("m") - F.col("lo") + F.col("s") + 1).drop("p", "m", "c", "lo", "s")


def scanned(df: DataFrame, m, t, group: list[str], along: str) -> DataFrame:
    """Inclusive scan of v along an axis within each group, in two levels."""
    out = m.result(t)
    df = ranged(df, *group, along)
    w = Window.partitionBy(*group, "p").orderBy(along).rowsBetween(Window.unboundedPreceding, 0)
    inner = df.withColumn("w", _running(m, F.col("v"), w, t).cast(out.spark))
    if m.name == "any":
        tot = df.groupBy(*group, "p").agg(F.min_by("v", along).alias("s"))
    else:
        tot = folded(df.select(*group, "p", "v"), [*group, "p"], m, t).withColumnRenamed("v", "s")
    before = Window.partitionBy(*group).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)  # a row per range that the group is in
    tot = tot.withColumn("c", _running(m, F.col("s"), before, out).cast(out.spark)).withColumn("n", F.count(F.lit(1)).over(before)).where("n > 0").select(*group, "p", "c")
    both = F.col("c") if m.name == "any" else m.binaryop.compute(F.col("c"), F.col("w"), out, out)
    res = inner.join(tot.withColumn("later", F.lit(True)), [*group, "p"], "left")
    return res.select(*group, along, F.when(F.col("later"), both).otherwise(F.col("w")).alias("v"))


def _by_column(order: str) -> bool:
    o = order.lower()
    if o in ("rowwise", "row", "rows", "c", "r"):
        return False
    if o in ("columnwise", "column", "columns", "col", "f"):
        return True
    raise ValueError(f"no such order: {order}")


def _running(m, v: Column, w, t) -> Column:
    """An inclusive scan with monoid m over window w."""
    n = m.name
    if n in ("plus", "min", "max", "any", "times", "lor", "land", "bor", "band", "bxor", "lxor") and not (n == "times" and t.kind in "iu"):
        simple = {"plus": F.sum, "bor": F.bit_or, "band": F.bit_and, "bxor": F.bit_xor, "lor": F.bool_or, "land": F.bool_and}
        if n == "any":
            return F.first(v).over(w)
        if n == "times":
            return (F.bool_and(v) if t.kind == "b" else F.product(v)).over(w)
        if n in ("min", "max"):
            f = F.min if n == "min" else F.max
            if t.kind == "b":
                return (F.bool_and if n == "min" else F.bool_or)(v).over(w)
            return F.coalesce(f(F.when(~F.isnan(v), v)).over(w), f(v).over(w)) if t.kind == "f" else f(v).over(w)
        if n == "lxor":
            return F.sum(v.cast("int")).over(w) % 2 == 1
        if n == "plus" and t.kind == "b":
            return F.bool_or(v).over(w)
        return simple[n](v).over(w)
    zero = dt.lit(m.identity(t), t)
    return F.reduce(F.collect_list(v).over(w), zero, lambda a, b: dt.wrap(m.binaryop.fn(dt.wide(a, t), dt.wide(b, t), t), t))


class MatrixExt:
    def __init__(self, a: Matrix):
        self.a = a

    def _axis(self, order: str):
        return ("j", "i") if _by_column(order) else ("i", "j")

    def scan(self, op="plus", order="rowwise") -> Matrix:
        """Inclusive prefix scan of each row's (column's) stored entries."""
        own, along = self._axis(order)
        m, a = ops.as_monoid(op), self.a
        return Matrix.of(scanned(a.df, m, a.dtype, [own], along).select("i", "j", "v"), m.result(a.dtype), a.shape)

    def sort(self, op="lt", order="rowwise", *, values=True, permutation=True):
        """Each row sorted and packed to the left: (values, permutation); ties by index.

        By lt or gt this is a window; another BOOL operator of (a, b), true where a comes first,
        sorts each row as an array.
        """
        own, along = self._axis(order)
        f = ops.as_binary(op)
        name = f.name
        if name not in ("lt", "gt", "le", "ge"):
            df = _by_operator(self.a.df.select(own, F.col(along).alias("old"), "v"), [own], f, self.a.dtype).withColumnRenamed("at", along)
            return (
                Matrix.of(df.select("i", "j", "v"), self.a.dtype, self.a.shape) if values else None,
                Matrix.of(df.select("i", "j", F.col("old").alias("v")), INT64, self.a.shape) if permutation else None,
            )
        first = F.col("v").asc() if name[0] == "l" else F.col("v").desc()
        w = Window.partitionBy(own).orderBy(first, along)
        df = self.a.df.select(own, F.col(along).alias("old"), (F.row_number().over(w) - 1).cast("long").alias(along), "v")
        return (
            Matrix.of(df.select("i", "j", "v"), self.a.dtype, self.a.shape) if values else None,
            Matrix.of(df.select("i", "j", F.col("old").alias("v")), INT64, self.a.shape) if permutation else None,
        )

    def selectk(self, how: str, k: int, order="rowwise", *, seed: int = 0) -> Matrix:
        """The first, last, smallest, largest or random k entries of each row (column)."""
        own, along = self._axis(order)
        w = Window.partitionBy(own).orderBy(*_order(how, along, seed, own))
        df = self.a.df.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
        return Matrix.of(df, self.a.dtype, self.a.shape)

    def compactify(self, how="first", k=None, order="rowwise", *, reverse=False, asindex=False, seed: int = 0) -> Matrix:
        """Entries, or their indices, packed to the left in the order of ``how``."""
        own, along = self._axis(order)
        w = Window.partitionBy(own).orderBy(*_order(how, along, seed, own))
        df = self.a.df.withColumn("r", F.row_number().over(w))
        n = F.count(F.lit(1)).over(Window.partitionBy(own)) if reverse else None
        if k is not None:
            n = F.least(n, F.lit(k)) if reverse else None
        df = df.withColumn("n", n) if reverse else df
        df = df if k is None else df.where(F.col("r") <= k)
        place = (F.col("n") - F.col("r")) if reverse else (F.col("r") - 1)
        v = F.col(along) if asindex else F.col("v")
        df = df.select(F.col(own), place.cast("long").alias("p"), v.alias("w")).select(F.col(own), F.col("p").alias(along), F.col("w").alias("v")).select("i", "j", "v")
        width = self.a.shape[1 if along == "j" else 0] if k is None else k
        shape = (self.a.nrows, width) if along == "j" else (width, self.a.ncols)
        return Matrix.of(df, INT64 if asindex else self.a.dtype, shape)

    def head(self, n: int = 10, *, sort: bool = True):
        rows = (self.a.df.orderBy("i", "j") if sort else self.a.df).limit(n).collect()
        return [r.i for r in rows], [r.j for r in rows], [r.v for r in rows]

    def flatten(self, order="rowwise") -> Vector:
        a = self.a
        at = F.col("j") * a.nrows + F.col("i") if _by_column(order) else F.col("i") * a.ncols + F.col("j")
        return Vector.of(a.df.select(at.alias("i"), "v"), a.dtype, (a.nrows * a.ncols,))

    def reshape(self, nrows: int, ncols: int | None = None, order="rowwise") -> Matrix:
        n = self.a.nrows * self.a.ncols
        nrows, ncols = (nrows, ncols) if ncols is not None else nrows
        return self.flatten(order).ss.reshape(nrows, ncols, order) if n else self.a.dup()

    def concat(self, tiles) -> None:
        out = concat(tiles)
        if out.shape != self.a.shape:
            raise DimensionMismatch(f"{out.shape} into {self.a.shape}")
        self.a.df = out.dup(self.a.dtype).df

    def split(self, rows, cols=None) -> list[list[Matrix]]:
        """Tiles of the given heights and widths."""
        a = self.a
        sizes = [_sizes(s, n) for s, n in zip((rows, cols), a.shape, strict=True)]
        out, r = [], 0
        for h in sizes[0]:
            row, c = [], 0
            for w in sizes[1]:
                row.append(a[r : r + h, c : c + w].new())
                c += w
            out.append(row)
            r += h
        return out

    def build_diag(self, vector, k: int = 0) -> None:
        self.a.df = vector.diag(k).dup(self.a.dtype).df

    def build_scalar(self, rows, columns, value) -> None:
        self.a.df = Matrix.from_coo(rows, columns, value, self.a.dtype, nrows=self.a.nrows, ncols=self.a.ncols).df

    def iteritems(self, seek: int = 0):
        df = self.a.df.orderBy("i", "j")
        if seek < 0:
            seek = max(0, self.a.nvals + seek)
        return (((r.i, r.j), r.v) for n, r in enumerate(df.toLocalIterator()) if n >= seek)

    def iterkeys(self, seek: int = 0):
        return (k for k, _ in self.iteritems(seek))

    def itervalues(self, seek: int = 0):
        return (v for _, v in self.iteritems(seek))

    @property
    def is_iso(self) -> bool:
        r = self.a.df.agg(F.min("v") == F.max("v")).first()
        return bool(r[0])

    @property
    def iso_value(self) -> Scalar:
        if not self.is_iso:
            raise InvalidValue("the values differ")
        return Scalar.of(self.a.df.agg(F.min("v").alias("v")), self.a.dtype, ())

    @property
    def nbytes(self) -> int:
        return int(str(self.a.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

    format, orientation = "coo", "rowwise"

    def export(self, format="coo", **_) -> dict:
        """Arrays in the wanted layout."""
        a, f = self.a, (format or "coo").lower()
        base = {"format": f, "nrows": a.nrows, "ncols": a.ncols}
        if f in ("coo", "coor", "cooc"):
            i, j, v = a.to_coo()
            return base | {"rows": i, "cols": j, "values": v}
        if f in ("csr", "csc"):
            p, x, v = a.to_csr() if f == "csr" else a.to_csc()
            return base | {"indptr": p, "col_indices" if f == "csr" else "row_indices": x, "values": v}
        if f in ("hypercsr", "hypercsc"):
            own, p, x, v = a.to_dcsr() if f == "hypercsr" else a.to_dcsc()
            return base | {"rows" if f == "hypercsr" else "cols": own, "indptr": p, "col_indices" if f == "hypercsr" else "row_indices": x, "values": v}
        if f in ("fullr", "fullc"):
            return base | {"values": a.to_dense()}
        if f in ("bitmapr", "bitmapc"):
            import numpy as np

            i, j, v = a.to_coo()
            there = np.zeros(a.shape, bool)
            there[i.astype(int), j.astype(int)] = True
            return base | {"bitmap": there, "values": a.to_dense(0), "nvals": len(i)}
        raise ValueError(f"no such format: {format}")

    unpack = export

    @staticmethod
    def import_any(*, format, nrows=None, ncols=None, values=1.0, **x) -> Matrix:
        """From the arrays that export gives; ownership flags have no meaning here."""
        f = format.lower()
        if f in ("coo", "coor", "cooc"):
            return Matrix.from_coo(x["rows"], x["cols"], values, nrows=nrows, ncols=ncols)
        if f == "csr":
            return Matrix.from_csr(x["indptr"], x["col_indices"], values, ncols=ncols)
        if f == "csc":
            return Matrix.from_csc(x["indptr"], x["row_indices"], values, nrows=nrows)
        if f == "hypercsr":
            return Matrix.from_dcsr(x["rows"], x["indptr"], x["col_indices"], values, nrows=nrows, ncols=ncols)
        if f == "hypercsc":
            return Matrix.from_dcsc(x["cols"], x["indptr"], x["row_indices"], values, nrows=nrows, ncols=ncols)
        if f in ("fullr", "fullc"):
            return Matrix.from_dense(values)
        if f in ("bitmapr", "bitmapc"):
            import numpy as np

            i, j = np.nonzero(x["bitmap"])
            return Matrix.from_coo(i, j, np.asarray(values)[i, j], nrows=nrows, ncols=ncols)
        raise ValueError(f"no such format: {format}")

    def serialize(self, path: str, compression: str = "zstd") -> None:
        from lattica.sources.io import save

        save(self.a, path, compression)


class VectorExt:
    def __init__(self, v: Vector):
        self.v = v

    def scan(self, op="plus") -> Vector:
        """Inclusive prefix scan: within ranges, then over their totals."""
        m, a = ops.as_monoid(op), self.v
        return Vector.of(scanned(a.df, m, a.dtype, [], "i"), m.result(a.dtype), a.shape)

    def _ranked(self, *order) -> DataFrame:
        return ranked(self.v.df, *order)

    def sort(self, op="lt", *, values=True, permutation=True):
        """Sorted and packed to the front; an operator other than lt or gt sorts the vector as one array."""
        f = ops.as_binary(op)
        name = f.name
        if name not in ("lt", "gt", "le", "ge"):
            df = _by_operator(self.v.df.select(F.col("i").alias("old"), "v"), [], f, self.v.dtype).withColumnRenamed("at", "i")
            return (Vector.of(df.select("i", "v"), self.v.dtype, self.v.shape) if values else None, Vector.of(df.select("i", F.col("old").alias("v")), INT64, self.v.shape) if permutation else None)
        df = self._ranked(F.col("v").asc() if name[0] == "l" else F.col("v").desc(), "i").select((F.col("r") - 1).alias("i"), "v", F.col("i").alias("old"))
        return (Vector.of(df.select("i", "v"), self.v.dtype, self.v.shape) if values else None, Vector.of(df.select("i", F.col("old").alias("v")), INT64, self.v.shape) if permutation else None)

    def selectk(self, how: str, k: int, *, seed: int = 0) -> Vector:
        return Vector.of(self.v.df.orderBy(*_order(how, "i", seed)).limit(k), self.v.dtype, self.v.shape)

    def compactify(self, how="first", k=None, *, reverse=False, asindex=False, seed: int = 0) -> Vector:
        df = self.v.df if k is None else self.selectk(how, k, seed=seed).df
        own = VectorExt(Vector.of(df, self.v.dtype, self.v.shape))._ranked(*_order(how, "i", seed))
        n = df.count() if reverse else 0
        place = (F.lit(n) - F.col("r")) if reverse else (F.col("r") - 1)
        out = own.select(place.cast("long").alias("p"), (F.col("i") if asindex else F.col("v")).alias("v")).withColumnRenamed("p", "i")
        return Vector.of(out, INT64 if asindex else self.v.dtype, (self.v.size if k is None else k,))

    def reshape(self, nrows, ncols: int | None = None, order="rowwise") -> Matrix:
        if ncols is None:
            nrows, ncols = nrows
        n = self.v.size
        if -1 in (nrows, ncols):
            nrows, ncols = (n // ncols, ncols) if nrows == -1 else (nrows, n // nrows)
        if nrows * ncols != n:
            raise DimensionMismatch(f"{n} entries into {nrows} x {ncols}")
        d = nrows if _by_column(order) else ncols
        q, r = F.call_function("div", F.col("i"), F.lit(max(1, d)).cast("long")), F.col("i") % max(1, d)
        i, j = (r, q) if _by_column(order) else (q, r)
        return Matrix.of(self.v.df.select(i.alias("a"), j.alias("j"), "v").withColumnRenamed("a", "i"), self.v.dtype, (nrows, ncols))

    def head(self, n: int = 10, *, sort: bool = True):
        rows = (self.v.df.orderBy("i") if sort else self.v.df).limit(n).collect()
        return [r.i for r in rows], [r.v for r in rows]

    def concat(self, tiles) -> None:
        at, df = 0, None
        for t in tiles:
            part = t.df.select((F.col("i") + at).alias("i"), dt.cast(F.col("v"), t.dtype, self.v.dtype).alias("v"))
            df, at = part if df is None else df.union(part), at + t.size
        if at != self.v.size:
            raise DimensionMismatch(f"{at} into {self.v.size}")
        self.v.df = df

    def split(self, sizes) -> list[Vector]:
        out, at = [], 0
        for n in _sizes(sizes, self.v.size):
            out.append(self.v[at : at + n].new())
            at += n
        return out

    def build_diag(self, matrix, k: int = 0) -> None:
        self.v.df = matrix.diag(k).dup(self.v.dtype).df

    def build_scalar(self, indices, value) -> None:
        self.v.df = Vector.from_coo(indices, value, self.v.dtype, size=self.v.size).df

    def iteritems(self, seek: int = 0):
        if seek < 0:
            seek = max(0, self.v.nvals + seek)
        return ((r.i, r.v) for n, r in enumerate(self.v.df.orderBy("i").toLocalIterator()) if n >= seek)

    def iterkeys(self, seek: int = 0):
        return (k for k, _ in self.iteritems(seek))

    def itervalues(self, seek: int = 0):
        return (v for _, v in self.iteritems(seek))

    is_iso, iso_value, nbytes = (property(lambda s, n=n: getattr(MatrixExt(s.v), n)) for n in ("is_iso", "iso_value", "nbytes"))
    format = "sparse"

    def export(self, format="sparse", **_) -> dict:
        i, v = self.v.to_coo()
        f = (format or "sparse").lower()
        if f == "sparse":
            return {"format": f, "size": self.v.size, "indices": i, "values": v}
        if f == "full":
            return {"format": f, "size": self.v.size, "values": self.v.to_dense()}
        if f == "bitmap":
            import numpy as np

            there = np.zeros(self.v.size, bool)
            there[i.astype(int)] = True
            return {"format": f, "size": self.v.size, "bitmap": there, "values": self.v.to_dense(0), "nvals": len(i)}
        raise ValueError(f"no such format: {format}")

    unpack = export

    @staticmethod
    def import_any(*, format, size=None, values=1.0, **x) -> Vector:
        import numpy as np

        f = format.lower()
        if f == "sparse":
            return Vector.from_coo(x["indices"], values, size=size)
        if f == "full":
            return Vector.from_dense(values)
        at = np.flatnonzero(x["bitmap"])
        return Vector.from_coo(at, np.asarray(values)[at], size=size)

    def serialize(self, path: str, compression: str = "zstd") -> None:
        from lattica.sources.io import save

        save(self.v, path, compression)


def _by_operator(df: DataFrame, group: list[str], op, t) -> DataFrame:
    """Rows (old, v) of each group in the order of a BOOL operator, numbered by ``at``; a group is one array."""
    comes = lambda a, b: op.compute(a["v"], b["v"], t, t)
    order = lambda a, b: F.when(comes(a, b) & ~comes(b, a), -1).when(comes(b, a) & ~comes(a, b), 1).otherwise(F.signum((a["old"] - b["old"]).cast("double")).cast("int"))
    if op.out(t, t) != dt.BOOL:
        raise NotImplementedException("sort by a BOOL operator")
    rows = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("v", "old")), order).alias("x"))
    return rows.select(*group, F.posexplode("x").alias("at", "y")).select(*group, F.col("at").cast("long").alias("at"), "y.v", "y.old")


def _order(how: str, along: str, seed: int, *also: str):
    return {
        "first": [F.col(along)], "last": [F.col(along).desc()], "smallest": [F.col("v"), F.col(along)], "largest": [F.col("v").desc(), F.col(along)],
        "random": [F.xxhash64(F.lit(seed), *also, along), F.col(along)],
    }[how]


def _sizes(chunks, n: int) -> list[int]:
    if chunks is None:
        return [n]
    if isinstance(chunks, int):
        return [min(chunks, n - i) for i in range(0, n, chunks)]
    out = [n - sum(c for c in chunks if c is not None) if c is None else c for c in chunks]
    if sum(out) != n:
        raise DimensionMismatch(f"chunks {out} of {n}")
    return out


def concat(tiles) -> Matrix:
    """One matrix from rows of tiles (or a list of vectors, stacked)."""
    rows = [r if isinstance(r, list | tuple) else [r] for r in tiles]
    rows = [[t.as_matrix() if isinstance(t, Vector) else t for t in r] for r in rows]
    df, at, width = None, 0, None
    own = rows[0][0].dtype
    for t in (t for r in rows for t in r):
        own = dt.unify(own, t.dtype)
    for r in rows:
        c = 0
        for t in r:
            part = t.df.select((F.col("i") + at).alias("i"), (F.col("j") + c).alias("j"), dt.cast(F.col("v"), t.dtype, own).alias("v"))
            df = part if df is None else df.union(part)
            c += t.ncols
        if width not in (None, c) or len({t.nrows for t in r}) > 1:
            raise DimensionMismatch("tiles do not fit")
        width, at = c, at + r[0].nrows
    return Matrix.of(df, own, (at, width))
