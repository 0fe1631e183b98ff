"""Quality classifier: a sparse rule ensemble compiled to Spark columns.

Statistics of each whole text are built-in column expressions. Boosted trees of
depth 3 over a bounded sample of labelled rows give conjunctive rules (every path
from the root to a node); lasso logistic regression weighs them, and what keeps a
weight is compiled into one column. Scoring runs no Python.

The sample holds at most ``sample`` labels and as many rows, those of smallest hash of doc_id, so the
bound is a parameter and the choice depends on the rows alone. Only its statistics
reach the driver; the label ids that pick it are broadcast, at most ``sample``.

Defined cases: null text counts as empty; labels of null or other than 0 and 1 are no
labels; of a doc_id's repeated rows each counts; without labels of both kinds every
score is the share of label 1, or 0.5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, DIGITS, JUNK = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "%$#&*@^~<>{}[]\\_="


def features(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    count = lambda chars: (F.length(t) - F.length(F.translate(t, chars, ""))).cast("double")
    words, lines = F.split(t, " "), F.split(t, "\n")
    gaps = count(" \n\t")
    return {
        "length": F.log1p(F.length(t).cast("double")),
        "upper": count(UPPER) / n,
        "digit": count(DIGITS) / n,
        "junk": count(JUNK) / n,
        "bang": count("!") / n,
        "bar": count("|") / n,
        "stop": count(".,;:") / n,
        "gap": gaps / n,
        "word": (F.length(t) - gaps) / (gaps + 1),
        "line": F.log1p(n / F.size(lines)),
        "distinct": F.size(F.array_distinct(words)) / F.size(words).cast("double"),
        "lines": F.size(F.array_distinct(lines)) / F.size(lines).cast("double"),
    }


Rule = tuple  # of (feature index, +1 for above or -1 for at most, threshold)


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], depth: int, path: Rule, rules: set, least: int = 20) -> np.ndarray:
    """Grows one tree on gradients; returns its values and adds its paths to rules."""
    if path:
        rules.add(path)
    value = np.full(len(g), g.sum() / (h.sum() + 1.0))
    if not depth or len(g) < 2 * least:
        return value
    best, where = 1e-6, None
    whole = g.sum() ** 2 / (h.sum() + 1)
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        b = np.searchsorted(c, x[:, f], side="left")
        gs, hs, ns = (np.cumsum(np.bincount(b, w, len(c) + 1))[:-1] for w in (g, h, np.ones(len(g))))
        gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - whole
        gain[(ns < least) | (len(g) - ns < least)] = 0
        i = int(np.argmax(gain))
        if gain[i] > best:
            best, where = gain[i], (f, float(c[i]))
    if where:
        f, c = where
        low = x[:, f] <= c
        for side, sign in ((low, -1), (~low, 1)):
            value[side] = _tree(x[side], g[side], h[side], cuts, depth - 1, tuple(sorted({*path, (f, sign, c)})), rules)
    return value


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.2) -> list[Rule]:
    cuts = [np.unique(np.quantile(c, np.linspace(0.02, 0.98, 33)))[:-1] if c.min() < c.max() else c[:0] for c in x.T]
    cuts = [np.unique(np.concatenate([c, [(np.min(v[v > v.min()]) + v.min()) / 2]])) if len(c) or v.min() < v.max() else c for c, v in zip(cuts, x.T, strict=True)]
    f, rules = np.zeros(len(y)), set()
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        f += rate * 2 * _tree(x, y - p, p * (1 - p), cuts, depth, (), rules)
    return sorted(rules)


def holds(x: np.ndarray, rule: Rule) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, sign, c in rule:
        out &= x[:, f] > c if sign > 0 else x[:, f] <= c
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an l1 penalty by accelerated proximal gradient steps; (bias, weights)."""
    n, m = r.shape
    step = 4 * n / (np.linalg.norm(np.column_stack([np.ones(n), r]), 2) ** 2 + 1e-9)
    w = v = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        d = 1 / (1 + np.exp(-(v[0] + r @ v[1:]))) - y
        new = v - step * np.concatenate([[d.mean()], d @ r / n])
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


class Ensemble:
    def __init__(self, bias: float, rules: list[tuple[Rule, float]], names: list[str]):
        self.bias, self.rules, self.names = bias, rules, names

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum((w * holds(x, r) for r, w in self.rules), np.zeros(len(x)))

    def column(self, cols: dict[str, Column]) -> Column:
        """The probability of label 1, from columns that hold the statistics."""
        z = F.lit(self.bias)
        for rule, w in self.rules:
            cond = F.lit(True)
            for f, sign, c in rule:
                x = cols[self.names[f]]
                cond = cond & (x > F.lit(c) if sign > 0 else x <= F.lit(c))
            z = z + F.when(cond, F.lit(w)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.exp(-z) + 1.0)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], penalty: float = 0.002, max_rules: int = 400) -> Ensemble:
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or not len(y):
        return Ensemble(float(np.log((share + 1e-3) / (1 - share + 1e-3))), [], names)
    rules = grow(x, y)
    r = np.column_stack([holds(x, q) for q in rules]).astype(float) if rules else np.zeros((len(y), 0))
    _, at = np.unique(r, axis=1, return_index=True)  # rules that hold for the same rows are one
    at = at[np.argsort(-np.abs((r[:, at] - r[:, at].mean(axis=0)).T @ (y - share)), kind="stable")][:max_rules]
    bias, w = lasso(r[:, at], y, penalty)
    return Ensemble(bias, [(rules[i], float(v)) for i, v in zip(at, w, strict=True) if v], names)


def learn(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Ensemble:
    """From docs (doc_id, text) and labels (doc_id, quality)."""
    cols = features(F.col("text"))
    y = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    # a threshold on the hash leaves about twice the sample to be sorted, however many labels there are
    n, h = y.count(), F.xxhash64("doc_id")
    low = y.filter(h <= int(-(1 << 63) + min(1.0, 2.0 * sample / max(1, n)) * ((1 << 64) - 2048)))
    if low.count() < min(n, sample):
        low = y
    chosen = low.orderBy(h, "doc_id", "y").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", F.xxhash64("text").alias("th"), "y", *(c.alias(k) for k, c in cols.items()))
    rows = rows.orderBy(h, "doc_id", "th", "y").limit(sample).toPandas()  # a doc_id may have any number of rows
    return fit(rows[list(cols)].to_numpy(float), rows["y"].to_numpy(float), list(cols))


def report(docs: DataFrame, labels: DataFrame, held_out, sample: int = 20_000) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted; held_out: makes the condition from a column name."""
    held = F.coalesce(held_out("doc_id"), F.lit(False))
    model = learn(docs, labels.filter(~held), sample)
    cols = features(F.col("text"))
    out = docs.select("doc_id", held.alias("held_out"), *(c.alias(f"__{k}") for k, c in cols.items()))
    out = out.select("doc_id", "held_out", model.column({k: F.col(f"__{k}") for k in cols}).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
