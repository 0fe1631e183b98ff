import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lattica.llm import katz
from lattica.llm.common import crc_mod

WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def discounts(counts):
    """Good-Turing's d_r, by the formula: r from 1 to K."""
    n, k = Counter(counts), katz.K
    out = {}
    for r in range(1, k + 1):
        tail = (k + 1) * n[k + 1] / n[1] if n[1] else 1
        d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail) if n[r] and tail < 1 else 0
        out[r] = d if 0.05 < d < 1 else 1 - 0.5 / r
    return lambda r: r * out.get(r, 1)


def model(rows, order):
    """A dictionary version: returns the functions of a text and of a context, and the counts of words."""
    held = lambda k: k is not None and zlib.crc32(str(k).encode()) % 10 == 0
    toks = lambda t: [*WORD.findall((t or "").encode().lower()), None]
    grams = [Counter()] + [defaultdict(Counter) for _ in range(order - 1)]  # by order; contexts are tuples
    contexts = lambda w, i: [tuple(["<s>", *w][i + 2 - n : i + 1]) if i + 2 - n >= 0 else None for n in range(2, order + 1)]
    for k, t in rows:
        if not held(k):
            w = toks(t)
            grams[0].update(w)
            for i, x in enumerate(w):
                for n, v in enumerate(contexts(w, i), 1):
                    if v is not None:
                        grams[n][v][x] += 1
    c = grams[0]
    total = sum(c.values())
    mass = [discounts(c.values()), *(discounts(r for x in g.values() for r in x.values()) for g in grams[1:])]
    lost = sum(r - mass[0](r) for r in c.values())
    extra = 0 if lost > 0 else 1

    def p(v, w):
        if not v:
            return mass[0](c[w]) / (total + extra) if c[w] else (lost + extra) / (total + extra) if total else 1.0
        seen, m = grams[len(v)][v], mass[len(v)]
        n = sum(seen.values())
        if not n:
            return p(v[1:], w) if len(v) > 1 else p((), w)
        big = n + (n * katz.HOT > total or v == ("<s>",) or all(r > katz.K for r in seen.values()))
        if seen[w]:
            return m(seen[w]) / big
        return (1 - sum(map(m, seen.values())) / big) / (1 - sum(p(v[1:], x) for x, r in seen.items() if r)) * p(v[1:], w)

    def score(t):
        w = toks(t)
        best = [[v for v in contexts(w, i) if v is not None][-1] for i in range(len(w))]
        return sum(math.log10(p(v, x)) for v, x in zip(best, w)), sum(math.log10((c[x] + 0.1) / (total + 0.1 * (len(c) + 1))) for x in w), sum(c[x] > 0 for x in w), total

    return score, held, p, grams


def data():
    r = random.Random(7)
    word = lambda: "".join(r.choice("abc") for _ in range(min(6, int(r.expovariate(0.5)) + 1)))
    rows = [(i, " ".join(word() for _ in range(r.randint(0, 90)))) for i in range(150)]
    return rows + [(200, None), (201, ""), (202, "A b\tC d é"), (None, "null id here"), (203, rows[3][1]), (3, rows[3][1]), (204, "new " * 3000)]


@pytest.mark.parametrize("order", [2, 3, 4])
@pytest.mark.parametrize("hot", [1000, 40])
def test_against_dictionary_version(spark, monkeypatch, order, hot):
    monkeypatch.setattr(katz, "HOT", hot)
    rows = data()
    score, held, p, grams = model(rows, order)
    words = [*grams[0], b"unknown word"]
    assert abs(sum(p((), w) for w in words) - 1) < 1e-9
    for g in grams[1:]:
        for v in [*list(g)[:15], *sorted(g, key=lambda v: -sum(g[v].values()))[:5]]:
            assert abs(sum(p(v, w) for w in words) - 1) < 1e-9, v
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, score int").repartition(4)
    got = katz.report(df, crc_mod("doc_id", 10) == 0, order).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for g in got:
        s, base, known, total = score(texts[g.doc_id])
        assert g.held_out == held(g.doc_id) and (g.n_known, g.train_tokens) == (known, total)
        assert g.score == pytest.approx(s, rel=1e-9, abs=1e-9) and g.base_score == pytest.approx(base, rel=1e-9)


def test_empty_and_nothing_to_learn(spark):
    df = spark.createDataFrame([(k, "a b") for k in range(40) if zlib.crc32(str(k).encode()) % 10 == 0], "doc_id long, text string")
    assert all(r.score == 0 and r.n_known == 0 and r.train_tokens == 0 for r in katz.report(df, crc_mod("doc_id", 10) == 0).collect())
    assert katz.report(df.limit(0), crc_mod("doc_id", 10) == 0).count() == 0
