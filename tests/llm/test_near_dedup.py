import random
import re

from lattica.llm import near_dedup


def sets(text, size=2):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows):
    s = {k: sets(t) for k, t in rows}
    root = {k: k for k in s}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    ids = sorted(s)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if s[a] and s[b] and 100 * len(s[a] & s[b]) >= 80 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s[k]), find(k), find(k) == k) for k in ids}


def rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 5)))
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "One\ttwo "), (7, "é x"), (8, "")]
    for g in range(12):
        base = [word() for _ in range(r.randint(20, 90))]
        for _ in range(r.randint(1, 9)):
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = word()
            out.append((len(out), " ".join(w)))
    chain = [word() for _ in range(100)]  # each is like the next, the ends are not
    for _ in range(8):
        out.append((len(out), " ".join(chain)))
        for _ in range(4):
            chain[r.randrange(100)] = word()
    order = list(range(len(out)))
    r.shuffle(order)
    return [(order[i], t) for i, (_, t) in enumerate(out)]


def test_against_all_pairs(spark):
    data = rows()
    df = spark.createDataFrame([(k, t, 1) for k, t in data], "doc_id long, text string, n int").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute(data)


def test_repeated_rows_null_ids_empty_table(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, "a b c")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(0, None, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_dedup.near_duplicates(df.limit(0)).count() == 0
    assert near_dedup.keep_one(df, size=2).count() == 3


def test_components_of_a_path(spark):
    from lattica.llm.common import Scratch

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (5, 5)], "a long, b long")
    got = {r.v: r.root for r in near_dedup.components(edges, Scratch(spark, "t"), "x").collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
