"""Products whose cells the shape does not bound: no table of parts before the exchange, a join in as many partitions, rows as by SQL."""

import re

import duckdb
import pytest

import __spark_entry__ as entry
from lattica.operators import collection

SF = "/root/testdata/sf0.001"
NAMES = ["mxm_bor_bor", "mxm_bxor_band", "mxm_land_gt", "mxm_lor_eq", "mxm_lxor_eq", "mxm_max_min", "mxm_max_plus", "mxm_min_max", "mxm_min_plus", "mxm_plus_iseq", "mxm_plus_isgt"]


@pytest.mark.parametrize("name", NAMES)
def test_products_are_exchanged_before_they_are_folded(spark, monkeypatch, name):
    monkeypatch.setattr(collection, "PIECE", 8 << 10)
    monkeypatch.setattr(collection, "FEW", 0)
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    above, below = plan[: (at := re.search("Join", plan).start())], plan[at:]
    assert re.findall("HashAggregate|Exchange", above)[-1:] == ["Exchange"]  # nearest to the join
    n = re.findall(r"hashpartitioning\(i#\d+L?, j#\d+L?, (\d+)\), REPARTITION_BY_NUM", above)[-1]
    assert int(n) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert re.findall(r"hashpartitioning\(k#\d+L?, (\d+)\), REPARTITION_BY_NUM", below) == [n, n]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS FROM '{SF}/lineitem.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(db.execute(entry.oracle_sql()[name]).fetchall())
