"""Exact top-k by integer inner product, with vector-approximation files.

A vector's components are floor(1024 * x). The approximation of a vector holds, for
each component, the number of its cell among 256 equal cells between the smallest
and the largest component of the whole table; it is written beside the exact vector
and scanned first: for a query, a table of 256 upper bounds per component turns the
cells into an upper bound of the inner product. Vectors are read in falling order of
that bound until the k-th exact score is at least the next bound, so the rest need no
reading.

Queries come in blocks of ``block_bytes`` and each block is one pass over all rows, whose
results are written before the next; every task keeps its own k best per query from
batch to batch, and the tasks' lists are merged per query. Nothing grows with the square
of the table but the scores themselves. Cells and exact vectors lie in one file: with a
hundredth of all rows as queries the exact vectors that are read are spread over all of it,
so a pass reads it whole, and what the bounds save is the exact products.

Defined cases: vectors that are null or hold null or non-finite components take no
part; components so large that an inner product could leave 64 bits are an error;
vectors of differing lengths are compared as if padded with zeros; repeated
vec_ids are rows of their own, a query never meets its own vec_id; ties go to the
smaller vec_id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import Scratch, trimmed

CELLS = 256
SCALE = 1024.0
BLOCK_BYTES = 1 << 25


def integers(df: DataFrame) -> DataFrame:
    """(vec_id, z): floor(1024 * x) of the rows that take part."""
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == math.inf))
    rows = df.filter("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter(~bad)
    return rows.select("vec_id", F.transform("x", lambda v: F.floor(v * SCALE).cast("long")).alias("z"))


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    """Rows of a list column as int64, padded with zeros to d."""
    n = np.asarray(pc.list_value_length(col).fill_null(0)).astype(np.int64)
    flat = np.asarray(col.flatten())
    out = np.zeros((len(n), d), np.int64)
    out[np.arange(d) < n[:, None]] = flat
    return out


class Quantiser:
    """Equal cells over [lo, hi]; cell c holds the integers lo + c*width .. lo + (c+1)*width - 1."""

    def __init__(self, lo: int, hi: int, d: int):
        self.lo, self.d = lo, d
        self.width = max(1, -(-(hi - lo + 1) // CELLS))

    def cells(self, z: np.ndarray) -> np.ndarray:
        return ((z - self.lo) // self.width).astype(np.uint8)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(d, CELLS): the largest product of q's component with a value of the cell."""
        low = self.lo + np.arange(CELLS, dtype=np.int64) * self.width
        return np.maximum(q[:, None] * low, q[:, None] * (low + self.width - 1))


_NONE = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _best(q: np.ndarray, own: int, ids: np.ndarray, z: np.ndarray, upper: np.ndarray, k: int, so_far: tuple = _NONE) -> tuple[np.ndarray, np.ndarray]:
    """The k best (ids, scores) of a slice and those so far, reading exact vectors in falling order of their bound."""
    left, step = np.flatnonzero(ids != own), max(64, 4 * k)
    got_i, got_s = so_far
    if len(got_s) >= k:
        left = left[upper[left] >= got_s[k - 1]]
    while len(left):
        at = left
        if step < len(left):  # only rows not yet read are partitioned, so equal bounds cannot repeat or hide a row
            cut = np.argpartition(-upper[left], step - 1)
            at, left = left[cut[:step]], left[cut[step:]]
        else:
            left = left[:0]
        if len(got_s) >= k and got_s[k - 1] > upper[at].max():
            break  # an equal bound could still be a tie with a smaller id
        got_i, got_s = np.concatenate([got_i, ids[at]]), np.concatenate([got_s, z[at] @ q])
        best = np.lexsort((got_i, -got_s))[:k]
        got_i, got_s = got_i[best], got_s[best]
        step *= 2
    return got_i, got_s


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, block: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) from two tables of (vec_id, embedding); block: queries of a pass, else by block_bytes."""
    spark = queries.sparkSession
    scratch = Scratch(spark, "vectors")
    exact = integers(candidates)
    stats = exact.agg(F.min(F.array_min("z")), F.max(F.array_max("z")), F.max(F.size("z"))).first()
    wanted = scratch.save(integers(queries), "queries")
    widest, low, high = wanted.agg(F.max(F.size("z")), F.min(F.array_min("z")), F.max(F.array_max("z"))).first()
    d = max(stats[2] or 0, widest or 0)
    reach = lambda *x: max((abs(v) for v in x if v is not None), default=0)
    if reach(stats[0], stats[1]) * reach(low, high) * d >= 1 << 62:
        raise ValueError("components too large: an inner product could leave 64 bits")
    quant = Quantiser(min(stats[0] or 0, 0), max(stats[1] or 0, 0), d)

    def approximate(batches):
        for b in batches:
            z = _matrix(b.column(1), d)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in quant.cells(z)], pa.binary()), pa.array([r.tobytes() for r in z], pa.binary())], names=["vec_id", "cells", "z"])

    file = scratch.save(exact.mapInArrow(trimmed(approximate), "vec_id long, cells binary, z binary"), "va")
    w = Window.partitionBy("query_row", "query_id").orderBy(F.desc("score"), "vec_id")
    merged = lambda df: df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    block, rows, parts = block or max(1, block_bytes // (8 * max(1, d))), [], []
    for n, r in enumerate(wanted.toLocalIterator()):
        rows.append((n, r))
        if len(rows) == block:
            parts.append(scratch.save(merged(_search(file, rows, quant, k)), f"found/{len(parts)}"))
            rows = []
    if rows or not parts:
        last = merged(_search(file, rows, quant, k))
        if not parts:
            return last
        parts.append(scratch.save(last, f"found/{len(parts)}"))
    return spark.read.schema(parts[0].schema).parquet(*(scratch.path(f"found/{i}") for i in range(len(parts))))


def _search(file: DataFrame, rows: list, quant: Quantiser, k: int) -> DataFrame:
    """Each task's k best of a block of queries."""
    first = rows[0][0] if rows else 0
    ids = np.array([r.vec_id for _, r in rows], np.int64)
    q = np.zeros((len(rows), quant.d), np.int64)
    for i, (_, r) in enumerate(rows):
        q[i, : len(r.z)] = r.z
    shared = file.sparkSession.sparkContext.broadcast((ids, q))

    def fn(batches):
        ids, q = shared.value
        best: list = [_NONE] * len(ids)
        for b in batches:
            own = np.asarray(b.column(0))
            n = len(own)
            if not n or not quant.d:
                continue
            cells = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(n, quant.d)
            z = np.frombuffer(b"".join(b.column(2).to_pylist()), np.int64).reshape(n, quant.d)
            at = cells.T + (np.arange(quant.d) * CELLS)[:, None]
            for i in range(len(ids)):
                table = quant.bounds(q[i]).ravel()
                upper = table[at].sum(axis=0)
                best[i] = _best(q[i], ids[i], own, z, upper, k, best[i])
        lens = [len(x[0]) for x in best]
        if sum(lens):
            row = np.repeat(np.arange(len(ids)), lens)
            yield pa.RecordBatch.from_arrays([pa.array(row + first), pa.array(ids[row]), pa.array(np.concatenate([x[0] for x in best])), pa.array(np.concatenate([x[1] for x in best]))], names=["query_row", "query_id", "vec_id", "score"])

    return file.select("vec_id", "cells", "z").mapInArrow(trimmed(fn), "query_row long, query_id long, vec_id long, score long")


ORACLE = """
WITH z AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS z FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.z, c.z), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM z q JOIN z c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
