import hashlib
import random
import re

import pytest

from lattica.llm import decontaminate

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
cut = lambda t: WORD.findall((t or "").encode().lower())


def brute(docs, items, window=10):
    wins = {}
    for k, t in items:
        w = cut(t)
        for i in range(len(w) - window + 1) if len(w) >= window else [0] * bool(w):
            wins.setdefault(tuple(w[i : i + window]), set()).add(k)
    sizes = {len(w) for w in wins}
    out = {}
    for d, t in docs:
        w = cut(t)
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[x]
        ids = sorted(str(k) for k in found if k is not None)
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    return out


def data(seed, short):
    r = random.Random(seed)
    word = lambda: r.choice(["la", "le", "na", "ño", "x1", "the", "of"])
    items = [(i, " ".join(word() for _ in range(r.randint(0 if short else 10, 40)))) for i in range(30)] + [(3, "of of THE la la la na na na x1 x1"), (50, None), (None, "zz yy xx ww vv uu tt ss rr qq pp")]
    docs = [(0, None), (1, ""), (2, "zz-yy xx ww vv uu tt ss rr qq pp oo")]
    for d in range(3, 90):
        text = " ".join(word() + r.choice(["", ",", ".", "!"]) for _ in range(r.randint(0, 60)))
        if d % 3 == 0:
            t = cut(r.choice(items)[1])
            lo = r.randint(0, 20)
            text += " " + " ".join(x.decode() for x in t[lo : lo + r.randint(5, 20)]) + " ENDS here " + text[:40]
        docs.append((d, text))
    return docs, items


@pytest.mark.parametrize("seed,short,block", [(1, False, 10**6), (2, True, 10**6), (3, True, 100)])
def test_against_brute_force(spark, seed, short, block):
    docs, items = data(seed, short)
    d = spark.createDataFrame([(k, t, "z") for k, t in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.report(d, b, block_words=block).collect()}
    assert got == brute(docs, items)


def test_empty_tables_and_clean(spark):
    d = spark.createDataFrame([(1, "keep this, one two three four five six seven eight nine ten. And that", 70), (2, "all clean", 9), (2, "all clean", 9), (3, "one two three four five six seven eight nine ten", 1)], "doc_id long, text string, n_chars long")
    b = spark.createDataFrame([(7, "One two three four five six seven eight nine ten")], "item_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_chars) for r in decontaminate.clean(d, b).collect())
    assert got == [(1, "keep this, . And that", 21), (2, "all clean", 9), (2, "all clean", 9)]
    assert decontaminate.report(d, b.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.report(d.limit(0), b).count() == 0
