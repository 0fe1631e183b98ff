"""Products in more partitions than a task writes straight to its file: the join has as many, rows as by SQL."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from lattica.operators import collection

SF = "/root/testdata/sf0.001"
NAMES = ["mxm_bxor_band", "mxm_land_gt", "mxm_lor_eq", "mxm_lxor_eq", "mxm_max_min", "mxm_max_plus", "mxm_min_max", "mxm_min_plus", "mxm_plus_iseq", "mxm_plus_isgt"]


@pytest.mark.parametrize("name", NAMES)
def test_join_has_as_many_partitions_past_direct(spark, monkeypatch, name):
    monkeypatch.setattr(collection, "PIECE", 1 << 10)
    monkeypatch.setattr(collection, "FEW", 0)
    monkeypatch.setattr(collection, "DIRECT", 8)
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    n = int(re.search(r"hashpartitioning\(i#\d+L?, j#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)[1])
    assert n > collection.DIRECT
    assert [int(x) for x in re.findall(r"hashpartitioning\(k#\d+L?, (\d+)\), REPARTITION_BY_NUM", plan)] == [n, n]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS FROM '{SF}/lineitem.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(db.execute(entry.oracle_sql()[name]).fetchall())
