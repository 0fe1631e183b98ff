"""Removal of byte strings that occur earlier in the corpus, by sparse prefix doubling.

Names of growing substrings take the part of a suffix array's ranks: ``names`` of
``seed`` bytes are paired at offsets seed, 2*seed, ... until they stand for
``min_bytes`` bytes. Doubling at every position would shuffle some 20 bytes for
each byte of text, so positions are thinned exactly: a window of ``min_bytes``
bytes is keyed by the leftmost smallest seed name in it (its anchor). Equal
windows have equal anchors at equal offsets, so a window can repeat only where its
anchor's name repeats, and one row per anchor (about 2 per 77 bytes) goes through
the exchange:

round 1  anchors are grouped by seed name; unique ones are done. Anchors whose
         whole stretch (the bytes of all their windows) equals another's are done
         too: all but the earliest are repeats.
round 2  what is left of a name's group differs somewhere in its stretches. The
         names of those windows alone are doubled up to ``min_bytes`` and grouped.

Rows travel as packed column blocks, one per batch and target partition, and
each batch of about ``SLAB`` bytes sends a stretch once, however often it holds it; so a passage that
stands in a third of all documents puts one row per batch, not per copy, on its
partition. Nothing is collected to the driver.

Defined cases: null text is empty; a null doc_id sorts before all others; rows that
share doc_id and text are one document and get one result; rows that share only the
doc_id are ordered by a hash of the text. Texts under ``min_bytes`` are kept whole.
Names are 64-bit hashes; windows count as equal where two of them agree, the seed's and
the stretch's or the window's own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import Scratch, binary, groups, guarded, n_parts, slabs, trimmed, with_columns
from lattica.llm.hashing import U, mix, powers, prefix, substr

LOW = U((1 << 20) - 1)
PIECE = 1 << 18  # windows handled at once, under 2^20
SLAB = 1 << 23  # bytes of text whose repeats are found before anything is sent
MARK = "k long, th long, runs binary, open binary"


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("k"), (F.xxhash64(text).bitwiseAND(0xFFFFFFFF)).alias("th"), text.alias("text"))


def seed_names(b: np.ndarray, pre: np.ndarray, seed: int) -> np.ndarray:
    _, inv = powers(len(pre))
    n = len(b) - seed + 1
    return mix((pre[seed:] - pre[:-seed]) * inv[:n])


def doubled(names: np.ndarray, seed: int, length: int) -> np.ndarray:
    """Names of ``length`` bytes from those of ``seed``: pairs at growing offsets."""
    while seed < length:
        step = min(seed, length - seed)
        names = mix(names[:-step] * U(0xD1342543DE82EF95) + names[step:])
        seed += step
    return names


def anchors(b: np.ndarray, ends: np.ndarray, seed: int, length: int):
    """(anchor, first window, windows, seed name, stretch name) of texts that end at ``ends`` in b."""
    n = len(b) - length + 1
    if n <= 0:
        return None
    pre = prefix(b)
    names = seed_names(b, pre, seed)
    low = (names & ~LOW) | np.arange(len(names), dtype=U)
    span, w = 1, length - seed + 1
    while span < w:
        step = min(span, w - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    at = (low & LOW).astype(np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    for s, e in zip(np.maximum(starts[1:] - length + 1, starts[:-1]), starts[1:], strict=True):
        at[s:e] = -1  # windows that would cross into the next text
    first = np.flatnonzero(np.diff(at, prepend=-2))
    count = np.diff(np.append(first, len(at)))
    ok = at[first] >= 0
    first, count = first[ok], count[ok]
    a = at[first]
    shape = (a - first).astype(U) * U(0xA24BAED4963EE407) + count.astype(U) * U(0x9FB21C651E98DF25)
    return a, first, count, names[a], mix(substr(pre, first, first + count - 1 + length) + shape)


def _pack(*cols: np.ndarray) -> bytes:
    return len(cols[0]).to_bytes(8, "little") + b"".join(np.ascontiguousarray(c).tobytes() for c in cols)


def _unpack(data: bytes, kinds: str) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for kind in kinds.split():
        a = np.frombuffer(data, dtype=kind, count=n, offset=at)
        at += a.nbytes
        out.append(a)
    return out


def _blocks(pid: np.ndarray, cols: list[np.ndarray]):
    """Rows dealt to partitions: (partition, packed columns)."""
    order = np.argsort(pid, kind="stable")
    cuts = np.flatnonzero(np.diff(pid[order], prepend=-1))
    for lo, hi in zip(cuts, [*cuts[1:], len(order)], strict=True):
        own = order[lo:hi]
        yield int(pid[own[0]]), _pack(*(c[own] for c in cols))


def _by_doc(k: np.ndarray, th: np.ndarray, values: np.ndarray):
    """One binary per document: the u4 rows of ``values``; all sorted by document."""
    cut = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (th[1:] != th[:-1])])) if len(k) else np.zeros(0, np.int64)
    ends = np.append(cut, len(k)).astype(np.int64) * values.dtype.itemsize * (values.shape[1] if values.ndim > 1 else 1)
    data = pa.py_buffer(np.ascontiguousarray(values).tobytes())
    return k[cut], th[cut], pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(ends.tobytes()), data]).cast(pa.binary())


def _marks(k, th, runs=None, opened=None) -> pa.RecordBatch:
    k, th, data = _by_doc(k, th, runs if runs is not None else opened)
    none = pa.nulls(len(k), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(k), pa.array(th), data if runs is not None else none, none if runs is not None else data], names=["k", "th", "runs", "open"])


ROUND1 = "<u8 <u8 <i8 <u4 <u4 <u2 <u2"


def _earliest(one: np.ndarray, two: np.ndarray, k, th, pos):
    """Order by (one, two, k, th, pos), two names that make a group; (order, group's start flags, row is not its group's earliest place)."""
    order = np.lexsort((pos, th, k, two, one))
    g, u, k, th, pos = one[order], two[order], k[order], th[order], pos[order]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (u[1:] != u[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(g)), 0))
    later = (k != k[first]) | (th != th[first]) | (pos != pos[first])
    return order, new, later


def _runs(first, count) -> np.ndarray:
    return np.stack([first, first + count], axis=1).astype("<u4")


def _round1_map(parts: int, seed: int, length: int):
    names = ["pid", "data", "k", "th", "runs", "open"]

    def fn(batches):
        for batch in slabs(batches, SLAB):
            ks, ths = (np.asarray(batch.column(i)) for i in (0, 1))
            texts = binary(batch.column(2))
            got = []
            for lo, hi in groups(texts, PIECE):
                if hi - lo == 1 and len(texts[lo]) > PIECE:
                    for s in range(0, len(texts[lo]) - length + 1, PIECE):
                        b = np.frombuffer(texts[lo], np.uint8)[s : s + PIECE + length - 1]
                        if (x := anchors(b, np.array([len(b)]), seed, length)) is not None:
                            got.append((np.full(len(x[0]), lo), x[0] + s, x[1] + s, *x[2:]))
                    continue
                ends = np.cumsum([len(t) for t in texts[lo:hi]])
                if (x := anchors(np.frombuffer(b"".join(texts[lo:hi]), np.uint8), ends, seed, length)) is not None and len(x[0]):
                    row = np.searchsorted(ends, x[0], side="right")
                    base = np.concatenate([[0], ends[:-1]])[row]
                    got.append((row + lo, x[0] - base, x[1] - base, *x[2:]))
            if not got:
                continue
            row, a, first, count, h, u = (np.concatenate(c) for c in zip(*got, strict=True))
            k, th = ks[row], ths[row]
            del texts, got, row  # only names go on
            order, new, later = _earliest(h, u, k, th, a)
            send = order[new]
            k2, h2, a2, f2 = k[send], h[send], a[send], first[send]
            by_place = np.lexsort((a2, k2))
            cols = [c[by_place] for c in (h2, u[send], k2, th[send].astype("<u4"), a2.astype("<u4"), (a2 - f2).astype("<u2"), count[send].astype("<u2"))]
            blocks = list(_blocks((cols[0] % U(parts)).astype(np.int64), cols))
            del cols, h, u, k2, h2, a2, f2, send, by_place, new
            n = len(blocks)
            none = pa.nulls(n, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in blocks], pa.int32()), pa.array([d for _, d in blocks], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), none, none], names=names)
            if len(rest := order[later]):
                rest = rest[np.lexsort((a[rest], th[rest], k[rest]))]
                m = _marks(k[rest], th[rest], runs=_runs(first[rest], count[rest]))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(m.num_rows, dtype=np.int32) % parts), pa.nulls(m.num_rows, pa.binary()), *m.columns], names=names)

    return fn


def _round1_reduce(batches):
    parts = []
    for batch in batches:
        data = batch.column(1)
        if (done := batch.filter(data.is_null())).num_rows:
            yield done.select(["k", "th", "runs", "open"])
        parts += [_unpack(d, ROUND1) for d in data.to_pylist() if d is not None]
    if not parts:
        return
    h, u, k, th, pos, off, count = (np.concatenate(c) for c in zip(*parts, strict=True))
    del parts
    order = np.argsort(h, kind="stable")
    g = h[order]
    shared = np.zeros(len(g), bool)
    if len(g) > 1:
        same = g[1:] == g[:-1]
        shared[1:] |= same
        shared[:-1] |= same
    own = order[shared]  # names that stand once are done
    if not len(own):
        return
    h, u, k, th, pos, off, count = (c[own].astype(np.int64) if c.dtype.itemsize < 8 else c[own] for c in (h, u, k, th, pos, off, count))
    order, new, later = _earliest(h, u, k, th, pos)
    first = pos - off
    if len(rest := order[later]):
        rest = rest[np.lexsort((pos[rest], th[rest], k[rest]))]
        yield _marks(k[rest], th[rest], runs=_runs(first[rest], count[rest]))
    rep = order[new]
    rep = rep[np.argsort(h[rep], kind="stable")]
    same = h[rep][1:] == h[rep][:-1]
    several = np.zeros(len(rep), bool)
    several[1:] |= same
    several[:-1] |= same
    if len(rep := rep[several]):
        rep = rep[np.lexsort((pos[rep], th[rep], k[rep]))]
        yield _marks(k[rep], th[rep], opened=np.stack([pos[rep], off[rep], count[rep]], axis=1).astype("<u4"))


ROUND2 = "<u8 <i8 <u4 <u4 <u2"


def _round2_map(parts: int, seed: int, length: int):
    def fn(batches):
        for batch in batches:
            ks, ths = (np.asarray(batch.column(i)) for i in (0, 1))
            out, keys = [], []
            for k, th, text, opened in zip(ks, ths, binary(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                x = np.unique(np.concatenate([np.frombuffer(o, "<u4") for o in opened]).reshape(-1, 3), axis=0).astype(np.int64)
                b = np.frombuffer(text, np.uint8)
                block = x[:, 0] // PIECE
                for at in np.unique(block):  # long texts in pieces
                    y = x[block == at]
                    lo, hi = int(np.min(y[:, 0] - y[:, 1])), int(np.max(y[:, 0] - y[:, 1] + y[:, 2])) + length
                    names = seed_names(b[lo:hi], prefix(b[lo:hi]), seed)
                    full = doubled(names, seed, length)
                    n = y[:, 2]
                    i = np.repeat(y[:, 0] - y[:, 1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    keys.append(mix(full[i - lo] + (np.repeat(y[:, 0], n) - i).astype(U)))
                    m = len(y)
                    out.append((names[y[:, 0] - lo], np.full(m, k), np.full(m, th, "<u4"), (y[:, 0] - y[:, 1]).astype("<u4"), n.astype("<u2")))
            if out:
                cols, flat = [np.concatenate(c) for c in zip(*out, strict=True)], np.concatenate(keys)
                pid = (cols[0] % U(parts)).astype(np.int64)
                own = np.repeat(pid, cols[4])  # of each window
                flat = flat[np.argsort(own, kind="stable")].astype("<u8")
                cuts = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=parts))])
                blocks = [(p, d + flat[cuts[p] : cuts[p + 1]].tobytes()) for p, d in _blocks(pid, cols)]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in blocks], pa.int32()), pa.array([d for _, d in blocks], pa.binary())], names=["pid", "data"])

    return fn


def _round2_reduce(batches):
    parts, keys = [], []
    for batch in batches:
        for d in batch.column(1).to_pylist():
            parts.append(_unpack(d, ROUND2))
            keys.append(np.frombuffer(d, "<u8", offset=8 + sum(c.nbytes for c in parts[-1])))
    if not parts:
        return
    h, k, th, first, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    w = np.concatenate(keys)
    del parts, keys
    n = n.astype(np.int64)
    e = np.repeat(np.arange(len(n)), n)
    k, th = k[e], th[e].astype(np.int64)
    pos = first[e].astype(np.int64) + np.arange(len(e)) - (np.cumsum(n) - n)[e]
    order, _, later = _earliest(h[e], w, k, th, pos)
    if len(rest := order[later]):
        rest = rest[np.lexsort((pos[rest], th[rest], k[rest]))]
        yield _marks(k[rest], th[rest], runs=_runs(pos[rest], 1))


def merged(runs: list[bytes] | None, length: int) -> np.ndarray:
    """Maximal byte runs that windows starting in ``runs`` cover, as rows (lo, hi)."""
    if not runs:
        return np.zeros((0, 2), np.int64)
    x = np.concatenate([np.frombuffer(r, "<u4") for r in runs]).reshape(-1, 2).astype(np.int64)
    x = x[np.argsort(x[:, 0], kind="stable")]
    hi = np.maximum.accumulate(x[:, 1] + length - 1)
    new = np.concatenate([[True], x[1:, 0] > hi[:-1]])
    return np.stack([x[new, 0], hi[np.append(np.flatnonzero(new)[1:] - 1, len(hi) - 1)]], axis=1)


def without(b: bytes, runs: np.ndarray) -> bytes:
    if not len(runs):
        return b
    cuts = [0, *runs.ravel().tolist(), len(b)]
    return b"".join(b[cuts[i] : cuts[i + 1]] for i in range(0, len(cuts), 2))


def repeated_runs(docs: DataFrame, scratch: Scratch, min_bytes: int = 100, seed: int = 25) -> DataFrame:
    """(k, th, runs): per document with repeats, packed ranges of repeated windows' starts."""
    spark, parts = docs.sparkSession, n_parts(docs.sparkSession)
    keyed = _keyed(docs)
    sent = keyed.mapInArrow(trimmed(_round1_map(parts, seed, min_bytes)), f"pid int, data binary, {MARK}")
    one = scratch.save(sent.repartitionById(parts, "pid").mapInArrow(trimmed(_round1_reduce), MARK), "round1")
    spark._jvm.System.gc()  # lets Spark delete the shuffle files of a round that is written
    opened = one.filter("open is not null").groupBy("k", "th").agg(F.collect_list("open").alias("open"))
    again = keyed.join(opened.hint("shuffle_hash"), ["k", "th"]).select("k", "th", "text", "open").mapInArrow(trimmed(_round2_map(parts, seed, min_bytes)), "pid int, data binary")
    two = scratch.save(again.repartitionById(parts, "pid").mapInArrow(trimmed(_round2_reduce), MARK), "round2")
    both = one.filter("runs is not null").select("k", "th", "runs").unionByName(two.select("k", "th", "runs"))
    spark._jvm.System.gc()
    return both.groupBy("k", "th").agg(F.collect_list("runs").alias("runs"))


def with_runs(docs: DataFrame, scratch: Scratch, min_bytes: int = 100) -> DataFrame:
    """docs with ``__runs``: packed starts of repeated windows, or null."""
    runs = repeated_runs(docs, scratch, min_bytes)
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.withColumns({"__k": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__th": F.xxhash64(text).bitwiseAND(0xFFFFFFFF)})
    runs = runs.select(F.col("k").alias("__k"), F.col("th").alias("__th"), F.col("runs").alias("__runs"))
    return keyed.join(runs.hint("shuffle_hash"), ["__k", "__th"], "left").select(*docs.columns, "__runs")


def report(docs: DataFrame, min_bytes: int = 100) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans."""
    joined = with_runs(docs.select("doc_id", "text"), Scratch(docs.sparkSession, "suffix"), min_bytes)
    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType())))]

    def fn(batch):
        out = []
        for b, runs in zip(binary(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            m = merged(runs, min_bytes)
            out.append((len(b), int((m[:, 1] - m[:, 0]).sum()), len(m), hashlib.sha256(without(b, m)).hexdigest(), m.tolist()))
        cols = list(zip(*out, strict=True)) or [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.list_(pa.int64()))]
        return [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]

    return with_columns(joined, fields, fn).drop("text", "__runs")


def strip(docs: DataFrame, min_bytes: int = 100) -> DataFrame:
    """docs without repeated bytes, the runs narrowed to whole characters; texts that this empties go."""
    docs, named = guarded(docs, "doc_id", "text", "n_chars")
    joined = with_runs(docs, Scratch(docs.sparkSession, "suffix"), min_bytes)
    at = joined.columns.index("text")

    def fn(batch):
        out = []
        for b, runs in zip(binary(batch.column(at)), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            m = merged(runs, min_bytes)
            for r in m:  # a character that is cut stays whole
                while r[0] < r[1] and b[r[0]] & 0xC0 == 0x80:
                    r[0] += 1
                while r[0] < r[1] < len(b) and b[r[1]] & 0xC0 == 0x80:
                    r[1] -= 1
            out.append(without(b, m).decode() if len(m) else None)
        return [pa.array(out, pa.string())]

    out = with_columns(joined, [T.StructField("__text", T.StringType())], fn).filter("__text is null or __text <> ''")
    text = F.coalesce("__text", "text")
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return named(out.select(docs.columns))
