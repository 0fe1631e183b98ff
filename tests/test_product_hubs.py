"""Products of an inner index with many entries are made in many tasks, each once; rows by brute force."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lattica import Matrix, semiring
from lattica.operators import collection

NAMES = ["mxm_bxor_band", "mxm_land_gt", "mxm_lor_eq", "mxm_lxor_eq", "mxm_max_min", "mxm_max_plus", "mxm_min_max", "mxm_min_plus", "mxm_plus_iseq", "mxm_plus_isgt"]
MUL = {"band": lambda a, b: a & b, "gt": lambda a, b: a > b, "eq": lambda a, b: a == b, "min": min, "max": max, "plus": lambda a, b: a + b, "iseq": lambda a, b: int(a == b), "isgt": lambda a, b: int(a > b)}
ADD = {"bxor": lambda a, b: a ^ b, "land": lambda a, b: a and b, "lor": lambda a, b: a or b, "lxor": lambda a, b: a != b, "max": max, "min": min, "plus": lambda a, b: a + b}


def cells(seed):
    """(supplier, part) to quantity: part 7 has 60 suppliers, part 8 has 60 of one flag and 2 of the other, the rest a few."""
    r = random.Random(seed)
    out = {(s, 7): r.randrange(1, 50) for s in range(60)} | {(s, 8): r.randrange(1, 50) for s in range(60 if seed else 2)}
    return out | {(r.randrange(90), p): r.randrange(1, 50) for p in range(9, 60) for _ in range(3)}


@pytest.fixture
def tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(collection, "PIECE", 1 << 8)
    monkeypatch.setattr(collection, "FEW", 0)
    monkeypatch.setattr(collection, "SIDE", 8, raising=False)
    rows = [(s, p, float(v), f) for f, seed in (("R", 0), ("A", 1)) for (s, p), v in cells(seed).items()]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double, l_returnflag string").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def brute(name):
    add, mul = name.split("_")[1:]
    a, b, out = cells(0), cells(1), {}
    for (i, k), x in a.items():
        for (j, m), y in b.items():
            if k == m:
                v = MUL[mul](x, y)
                out[i, j] = ADD[add](out[i, j], v) if (i, j) in out else v
    return out


@pytest.mark.parametrize("name", NAMES)
def test_products_of_a_hub_go_to_many_tasks(spark, tables, monkeypatch, name):
    seen, multiply = [], collection._multiply
    monkeypatch.setattr(collection, "_multiply", lambda df, *args: seen.append(df) or multiply(df, *args))
    df = entry.queries()[name](spark, tables)
    made = seen[-1].groupBy("k", F.spark_partition_id().alias("task")).count().where("k IN (7, 8)").collect()
    assert sum(r["count"] for r in made if r.k == 7) == 60 * 60 and sum(r["count"] for r in made if r.k == 8) == 60 * 2
    assert len([r for r in made if r.k == 7]) > 10 and max(r["count"] for r in made) < 60 * 60 // 4
    assert {(r.i, r.j): r.v for r in df.collect()} == brute(name) and df.count() == len(brute(name))


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("name", ["min_firstj", "max_secondi", "plus_times"])
def test_hubs_with_positions_and_empty_values(spark, tables, monkeypatch, name, adaptive):
    """As without any hub: inner positions stay, entries of null are counted as none and lost by none."""
    df = spark.read.parquet(f"{tables}/lineitem.parquet").withColumn("v", F.when(F.col("l_suppkey") % 5 != 0, F.col("l_quantity").cast("long")))
    a, b = (Matrix.from_df(df.where(F.col("l_returnflag") == f), "l_suppkey", "l_partkey", "v", shape=(1 << 20, 1 << 24)) for f in "RA")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        rows = lambda: sorted(map(tuple, a.mxm(b.T, getattr(semiring, name)).new().df.collect()), key=repr)
        cut = rows()
        monkeypatch.setattr(collection, "SIDE", 1 << 11)
        assert cut == rows() and len(cut) >= 60 * 60
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_products_of_products_are_not_counted_without_end(spark, tables):
    df = spark.read.parquet(f"{tables}/lineitem.parquet").where("l_returnflag = 'R' AND l_partkey > 8")
    a = Matrix.from_df(df, "l_suppkey", "l_partkey", F.col("l_quantity").cast("long"), shape=(1 << 13, 1 << 13))
    c = a
    for _ in range(3):
        c = c.mxm(c, semiring.max_min).new()
    assert c.df._jdf.queryExecution().optimizedPlan().collectLeaves().size() <= 4 * 100
