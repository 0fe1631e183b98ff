"""Some of the registered queries against DuckDB, and the entry module's contract."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 200


@pytest.mark.parametrize("name", ["mxm_min_plus", "ewise_add_minus", "write_not_V_accum", "assign_region", "scan_vector", "pagerank_3", "from_keys", "extract_col_list", "extract_into", "input_mask", "input_mask_complement", "type_UINT64_band", "type_INT8_times", "monoid_logaddexp_far_up", "unary_erf", "binary_gcd", "complex_plus_times", "inplace_or", "select_row", "sort_by_operator", "bfs_parents", "connected_components"])
def test_against_sql(spark, name):
    db = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = db.execute(f"select {', '.join(cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want)


def test_ranks_at_size(spark):
    """Ranges are written once: ranks stay whole however often the rows are read."""
    from pyspark.sql import functions as F

    from lattica import Vector
    from lattica.functions.dtypes import INT64

    n = 1_000_000
    v = Vector.of(spark.range(n).select((F.col("id") * 7919 % n).alias("i"), F.xxhash64("id").alias("v")), INT64, (n,))
    got = v.ss.compactify("first").df
    want = v.df.withColumnRenamed("v", "w")
    assert got.select("i").distinct().count() == n and got.agg(F.max("i")).first()[0] == n - 1
    assert got.join(want, "i").where("v = w").count() == n
    assert v.ss.scan("max").df.agg(F.count("v"), F.max("v")).first() == (n, v.df.agg(F.max("v")).first()[0])
