"""Benchmark decontamination with a generalised suffix automaton over words.

Items and documents are lower-cased (A-Z) and split at ASCII punctuation, control
characters and white space. A window is ``window`` consecutive words of an item, or
a whole shorter item. The automaton of all items is walked by each document's
words; the current state knows the longest suffix read so far that some item holds.

The items are the only thing broadcast, in blocks of at most ``block_words`` words
(an item is not split). Each block is a pass of its own over the documents, written
before the next begins, so a task holds one block's automaton (some 100 MB) however
large the benchmark is. Documents are never shuffled.

Only stretches whose words all stand in some item can hold a window, so the others
are skipped before the walk; this is exact.

Defined cases: null text has no words; an item without words has no window; rows
with a null item_id still mark words but count under no item; item_ids that repeat
are one item with several texts; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import Scratch, binary, guarded, trimmed

WINDOW = 10
BLOCK_WORDS = 200_000
SPLIT = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c < 0x30 or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256))
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(SPLIT).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items each state occurs in."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window, self.vocab = window, {}
        self.next, self.link, self.len = [{}], [-1], [0]
        lists = [(k, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for k, ws in items if ws]
        for _, ids in lists:
            last = 0
            for c in ids:
                last = self._extend(last, c)
        #: The items that hold a window, at the state that first stands for it.
        self.items: dict[int, set] = {}
        #: For each state, lengths of whole short items that are suffixes of its strings, and the items.
        self.short: dict[int, list[tuple[int, object]]] = {}
        self.least = window
        for k, ids in lists:
            if len(ids) < window:
                self.least = min(self.least, len(ids))
            s = 0
            for n, c in enumerate(ids, 1):
                s = self.next[s][c]
                if n >= window:
                    t = s
                    while self.len[self.link[t]] >= window:
                        t = self.link[t]
                    self.items.setdefault(t, set()).add(k)
            if len(ids) < window:
                self.short.setdefault(s, []).append((len(ids), k))
        for s in sorted(range(1, len(self.next)), key=self.len.__getitem__):
            if up := self.short.get(self.link[s]):
                self.short[s] = self.short.get(s, []) + up

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.len[q] == self.len[last] + 1 else self._clone(last, c, q)
        cur = self._state(self.len[last] + 1, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._clone(p, c, q)
        return cur

    def _state(self, n: int, edges: dict) -> int:
        self.next.append(edges)
        self.len.append(n)
        self.link.append(0)
        return len(self.next) - 1

    def _clone(self, p: int, c: int, q: int) -> int:
        new = self._state(self.len[p] + 1, dict(self.next[q]))
        self.link[new] = self.link[q]
        self.link[q] = new
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def scan(self, ids: np.ndarray, spans: list, found: set) -> None:
        """Adds the hit word ranges and the items with occurring windows; ids: -1 for foreign words."""
        known = np.concatenate([[False], ids >= 0, [False]])
        cut = np.flatnonzero(known[1:] != known[:-1])
        for lo, hi in zip(cut[::2].tolist(), cut[1::2].tolist(), strict=True):
            if hi - lo >= self.least:
                self._walk(ids, lo, hi, spans, found)

    def _walk(self, ids: np.ndarray, lo: int, hi: int, spans: list, found: set) -> None:
        nxt, link, length, window, short = self.next, self.link, self.len, self.window, self.short
        s = n = 0
        for i, c in enumerate(ids[lo:hi].tolist(), lo + 1):
            while s and c not in nxt[s]:
                s = link[s]
                n = length[s]
            if c in nxt[s]:
                s = nxt[s][c]
                n += 1
            if n >= window:
                spans.append((i - n, i))
                t = s
                while length[link[t]] >= window:
                    t = link[t]
                found |= self.items[t]
            if s in short:
                for m, k in short[s]:
                    if m <= n:
                        spans.append((i - m, i))
                        found.add(k)


def blocks(benchmark: DataFrame, window: int, block_words: int):
    """Automata of the benchmark, each of a bounded number of words."""
    rows, size = [], 0
    for r in benchmark.select("item_id", "text").toLocalIterator():
        ws = words((r.text or "").encode())
        if rows and size + len(ws) > block_words:
            yield Automaton(rows, window)
            rows, size = [], 0
        rows.append((r.item_id, ws))
        size += len(ws)
    yield Automaton(rows, window)


def union(spans: list) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted(map(tuple, spans)):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


FIELDS = [
    T.StructField("__n", T.LongType()), T.StructField("__spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("__items", T.ArrayType(T.StringType())),
]


def _pass(df: DataFrame, auto: Automaton, first: bool) -> DataFrame:
    """df with the word count, the hit word spans and the items; later passes add to earlier ones."""
    schema = T.StructType([*df.schema.fields, *(FIELDS if first else [])])
    shared = df.sparkSession.sparkContext.broadcast(auto)
    at = df.columns.index("text")

    def fn(batches):
        a = shared.value
        get = a.vocab.get
        for batch in batches:
            old = [(0, [], [])] * batch.num_rows if first else list(zip(*(batch.column(batch.num_columns + j).to_pylist() for j in range(-3, 0)), strict=True))
            out = []
            for b, (_, spans, items) in zip(binary(batch.column(at)), old, strict=True):
                ws = words(b)
                spans, found = [*spans], set()
                if a.vocab:
                    a.scan(np.fromiter((get(w, -1) for w in ws), np.int64, len(ws)), spans, found)
                out.append((len(ws), union(spans), sorted({*items, *(str(k) for k in found if k is not None)})))
            cols = list(zip(*out, strict=True)) or [()] * 3
            kinds = [pa.int64(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.string())]
            rest = batch.columns if first else batch.columns[:-3]
            yield pa.RecordBatch.from_arrays([*rest, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=schema.names)

    return df.mapInArrow(trimmed(fn), schema)


def with_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with ``__n``, ``__spans`` and ``__items``."""
    scratch, out = Scratch(docs.sparkSession, "hits"), docs
    for i, auto in enumerate(blocks(benchmark, window, block_words)):
        if i:
            out = scratch.save(out, f"pass{i}")
            if i > 1:
                scratch.drop(f"pass{i - 1}")
        out = _pass(out, auto, first=not i)
    return out


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans, items."""
    hits = with_hits(docs.select("doc_id", "text"), benchmark, window, block_words)
    n_hit = F.aggregate("__spans", F.lit(0).cast("long"), lambda x, s: x + s[1] - s[0])
    ids = F.sha2(F.concat_ws(",", "__items").cast("binary"), 256)
    return hits.select("doc_id", F.col("__n").alias("n_words"), n_hit.alias("n_hit"), F.size("__items").cast("long").alias("n_items"), ids.alias("items_sha256"), (F.size("__spans") > 0).alias("contaminated"), F.col("__spans").alias("spans"), F.col("__items").alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = 0.8) -> DataFrame:
    """docs with hit spans cut from their texts; documents that are hit in more than ``coverage`` of their words go."""
    docs, named = guarded(docs, "text", "n_chars")
    hits = with_hits(docs, benchmark, window)
    share = F.aggregate("__spans", F.lit(0).cast("long"), lambda x, s: x + s[1] - s[0]) / F.greatest("__n", F.lit(1))
    hits = hits.filter(share <= coverage)
    at, spans_at = hits.columns.index("text"), hits.columns.index("__spans")
    schema = T.StructType([*hits.schema.fields, T.StructField("__text", T.StringType())])

    def fn(batches):
        for batch in batches:
            out = []
            for b, spans in zip(binary(batch.column(at)), batch.column(spans_at).to_pylist(), strict=True):
                if not spans:
                    out.append(None)
                    continue
                place = [m.span() for m in _WORD.finditer(b)]
                kept, last = [], 0
                for lo, hi in spans:
                    kept.append(b[last : place[lo][0]])
                    last = place[hi - 1][1]
                out.append(b"".join([*kept, b[last:]]).decode())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=schema.names)

    out = hits.mapInArrow(trimmed(fn), schema).withColumn("text", F.coalesce("__text", "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return named(out.select(docs.columns))
