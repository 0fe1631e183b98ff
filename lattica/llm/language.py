"""Multilingual mixture inference: each document's language proportions by EM.

Learning counts byte trigrams of normalised words (lower case; everything but
letters is a space) per language over all learning rows, with map-side totals; the
table has languages x 2^15 entries, whatever the corpus, and is what is broadcast.
A document's trigrams are modelled as drawn from a mixture of languages. EM gives
the proportions over all languages; sets of growing size, in order of proportion, are
fitted again, and the set of largest log likelihood minus ``penalty`` * ln(trigrams) per
further language is taken. Sizes are tried until even the likelihood of all languages
together could not pay for one more.

``identified`` drops documents without a language: those that are ``und``, and those
whose mixture is less likely than uniform trigrams by more than the penalty of one
language (a few letters are no evidence against a text).

Defined cases: null text, or text without a letter: ``und``, score 0; nothing to
learn from: ``und`` for all; null lang is no learning row; over MAX_LANGS languages
is an error, since the table would no longer be bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import guarded, trimmed, with_columns

BINS = 1 << 15
MAX_LANGS = 1024
ALPHA = 0.5
_LETTER = regex.compile(r"\p{L}")
_CODE = np.zeros(256, np.uint32)
_CODE[97:123] = np.arange(1, 27)
_CODE[128:] = 27 + np.arange(128) % 101


def trigrams(text: str | None) -> np.ndarray:
    """Bins of the byte trigrams whose middle is no space."""
    b = np.frombuffer(b" " + (text or "").lower().encode("utf-8", "replace") + b" ", np.uint8)
    c = _CODE[b]
    g = (c[:-2] * np.uint32(128) + c[1:-1]) * np.uint32(128) + c[2:]
    g *= np.uint32(0x9E3779B1)
    return (g >> np.uint32(17))[c[1:-1] != 0]


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        p = (counts + ALPHA) / (counts.sum(axis=1, keepdims=True) + ALPHA * BINS)
        self.p = np.ascontiguousarray(p.T)  # bins x languages

    def infer(self, text: str | None, penalty: float = 2.0) -> tuple[str, float, list[tuple[str, float]], float]:
        """(language, its share, the set with shares, log likelihood less the uniform distribution's, plus the cost of a language)."""
        if not self.langs or not text or not _LETTER.search(text):
            return "und", 0.0, [], 0.0
        n = np.bincount(trigrams(text), minlength=BINS)
        at = np.flatnonzero(n)
        if not len(at):  # letters, but none that the normalisation keeps
            return self.langs[0], 0.0, [(self.langs[0], 1.0)], 1.0
        w = n[at].astype(float)
        p = self.p[at]
        alone = w @ np.log(p)
        first = int(np.argmax(alone))
        share, whole = _em(p, w, 25)
        order = np.argsort(-share, kind="stable")
        cost = penalty * np.log(w.sum() + 1)
        best = (alone[first], np.array([first]), np.ones(1))
        for k in range(2, len(order) + 1):
            if whole - cost * (k - 1) <= best[0]:
                break
            own = order[:k]
            share, fit = _em(p[:, own], w, 25)
            if fit - cost * (k - 1) > best[0]:
                best = (fit - cost * (k - 1), own, share)
        _, own, share = best
        i = int(np.argmax(share))
        gain = float(w @ np.log(p[:, own] @ share)) + float(w.sum()) * np.log(BINS) + cost
        return self.langs[own[i]], float(share[i]), [(self.langs[j], float(s)) for j, s in zip(own, share, strict=True)], gain


def _em(p: np.ndarray, w: np.ndarray, steps: int) -> tuple[np.ndarray, float]:
    share = np.full(p.shape[1], 1 / p.shape[1])
    total = w.sum()
    for _ in range(steps):
        new = share * ((w / (p @ share)) @ p) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-4:
            break
    return share, float(w @ np.log(p @ share))


def learn(rows: DataFrame) -> Model:
    """From rows (text, lang)."""
    def count(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in total:
                    total[lang] = np.zeros(BINS, np.int64)
                total[lang] += np.bincount(trigrams(text), minlength=BINS)
        for lang, c in total.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "bin", "n"])

    rows = rows.select("text", F.col("lang").cast("string").alias("lang")).filter("lang is not null")
    langs = sorted(r.lang for r in rows.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    counts, place = np.zeros((len(langs), BINS)), {x: i for i, x in enumerate(langs)}
    for r in rows.mapInArrow(trimmed(count), "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[place[r.lang], r.bin] = r.n
    return Model(langs, counts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with ``__lang``, ``__score``, ``__shares`` and ``__gain``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    fields = [T.StructField("__lang", T.StringType()), T.StructField("__score", T.DoubleType()), T.StructField("__shares", T.MapType(T.StringType(), T.DoubleType())), T.StructField("__gain", T.DoubleType())]

    def fn(batch):
        out = [shared.value.infer(t) for t in batch.column(at).to_pylist()]
        return [pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], pa.map_(pa.string(), pa.float64())), pa.array([x[3] for x in out], pa.float64())]

    return with_columns(docs, fields, fn)


def report(docs: DataFrame, held_out: Column) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, shares; learns from the rows not held out."""
    held = F.coalesce(held_out, F.lit(False))
    model = learn(docs.filter(~held))
    out = predict(docs.select("doc_id", "text", held.alias("held_out")), model)
    return out.select("doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"), F.col("__shares").alias("shares"))


def identified(docs: DataFrame) -> DataFrame:
    """docs without those that have no language: no text, no letter, or trigrams that no mixture explains."""
    docs, named = guarded(docs, "text", "lang")
    model = learn(docs)
    if not model.langs:
        return named(docs.filter(F.col("text").rlike(r"\p{L}")))
    return named(predict(docs, model).filter("__lang <> 'und' and __gain > 0").select(docs.columns))
