import math

import duckdb
import numpy as np

from lattica.llm import vector_search as vs


def brute(rows, k=10):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 100 == 0:
            s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
            out += [(q, n, i, -x) for n, (x, i) in enumerate(s, 1)]
    return sorted(out)


def run(df, **o):
    return sorted(map(tuple, vs.top_k(df.filter("vec_id % 100 = 0"), df, **o).collect()))


def test_against_brute_force(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(np.float32(x)) for x in r.normal(size=8)]) for i in range(700)]
    rows += [(1000 + i, rows[100][1]) for i in range(15)] + [(2000, None), (2001, [None] * 8), (2100, [math.nan] * 8), (2101, [math.inf] + [0.0] * 7), (2200, [0.0] * 8), (2300, [1.0] * 3), (2400, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    assert run(df) == brute(rows)
    assert run(df, block=3) == brute(rows)
    assert run(df.limit(0)) == [] and run(df.filter("vec_id in (0, 1, 100)")) == brute([r for r in rows if r[0] in (0, 1, 100)])


def test_sql(spark):
    d = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view embeddings as select * from '{d}/embeddings.parquet'")
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    assert run(df) == sorted(duckdb.sql(vs.ORACLE).fetchall())


def test_bounds_skip_reading():
    r = np.random.default_rng(2)
    z = (1024 * r.normal(size=(5000, 16))).astype(np.int64)
    q = z[0]
    quant = vs.Quantiser(int(z.min()), int(z.max()), 16)
    upper = quant.bounds(q).ravel()[quant.cells(z).T + (np.arange(16) * vs.CELLS)[:, None]].sum(axis=0)
    assert (upper >= z @ q).all() and (upper >= np.sort(z @ q)[-10]).sum() < 500


def test_many_copies_in_one_batch():
    r = np.random.default_rng(3)
    for n, copies in ((400, 300), (5000, 700), (1000, 1000)):
        z = (1024 * r.normal(size=(n, 8))).astype(np.int64)
        z[r.permutation(n)[:copies]] = q = z[np.argmax((z * z).sum(axis=1))].copy()
        ids = r.permutation(n) + 1
        quant = vs.Quantiser(int(z.min()), int(z.max()), 8)
        upper = quant.bounds(q).ravel()[quant.cells(z).T + (np.arange(8) * vs.CELLS)[:, None]].sum(axis=0)
        for own in (-1, int(ids[0])):
            i, s = ids[ids != own], (z @ q)[ids != own]
            best = np.lexsort((i, -s))[:10]
            got = vs._best(q, own, ids, z, upper, 10)
            assert got[0].tolist() == i[best].tolist() and got[1].tolist() == s[best].tolist()
