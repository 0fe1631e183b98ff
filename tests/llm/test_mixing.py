import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lattica.llm import mixing


def rows():
    out = []
    for s, n, size in (("big", 900, 20), ("mid", 200, 30), ("low", 25, 40), (None, 12, 9), ("none", 5, 0)):
        out += [(len(out) + i, s, "w " * (size + i % 7 if size else 0)) for i in range(n)]
    return out + [(10_000, "big", None), (10_001, "low", " \t"), (5, "big", "w " * 25), (5, "big", "w " * 25)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1) for r in rows()], "doc_id long, source string, text string, block int")


def weights(entropy, max_epochs, ratio=1.0):
    """By plain bisection."""
    tok = Counter()
    for _, s, t in rows():
        tok[s] += len((t or "").split())
    tok = {s: n for s, n in tok.items() if n}
    total = sum(tok.values())
    q = {s: n / total for s, n in tok.items()}
    w = lambda t: {s: x**t / sum(y**t for y in q.values()) for s, x in q.items()}
    h = lambda t: -sum(x * math.log(x) for x in w(t).values())
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if h(mid) >= entropy * math.log(len(q)) else (lo, mid)
    t, lo, hi = lo, 0.0, 1.0
    if max(w(0.0)[s] * ratio / q[s] for s in q) > max_epochs:
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (lo, mid) if max(w(mid)[s] * ratio / q[s] for s in q) <= max_epochs else (mid, hi)
        t = max(t, hi)
    return w(t), tok, total


@pytest.mark.parametrize("entropy,epochs", [(0.98, 4.0), (0.7, 50.0), (1.0, 3.0), (0.1, 4.0)])
def test_budgets(docs, entropy, epochs):
    got = mixing.report(docs, entropy=entropy, max_epochs=epochs, block_tokens=500).collect()
    w, tok, total = weights(entropy, epochs)
    drawn, copies = Counter(), defaultdict(set)
    for r in got:
        drawn[r.source] += r.n_tokens
        copies[r.doc_id].add(r.epoch)
        assert 0 <= r.position < 1 and r.n_tokens > 0
    for s in tok:
        assert -130 <= drawn[s] - w[s] * total <= 1, s
        assert drawn[s] <= epochs * tok[s] + 1
    assert all(e == set(range(len(e))) for e in copies.values())
    assert set(drawn) == set(tok)


def test_last_epoch_takes_whole_blocks(docs):
    got = mixing.report(docs, entropy=0.98, block_tokens=500)
    last = got.groupBy("source").agg(F.max("epoch").alias("e"))
    full = mixing.report(docs, entropy=0.0, block_tokens=500).groupBy("source", "block").agg(F.sum("n_tokens").alias("all"))
    part = got.join(last.filter("source = 'big'"), "source").filter("epoch = e").groupBy("source", "block").agg(F.sum("n_tokens").alias("n"), F.max("position").alias("p"))
    x = part.join(full, ["source", "block"]).collect()
    cut = [r for r in x if r.n != r.all]
    assert len(cut) <= 1 and all(r.p == max(y.p for y in x) for r in cut)


def test_empty_and_repeated(docs, spark):
    assert mixing.report(docs.limit(0)).count() == 0
    two = {tuple(sorted(Counter(r.epoch for r in mixing.report(docs).filter("doc_id = 5").collect()).values()))}
    assert all(x % 3 == 0 for t in two for x in t)
