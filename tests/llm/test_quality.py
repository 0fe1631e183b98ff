import numpy as np
from pyspark.sql import functions as F

from lattica.llm import quality
from lattica.llm.common import crc_mod

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_and_no_python(spark, capsys):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.report(docs, labels, lambda c: crc_mod(c, 3) == 1)
    rows = out.join(labels, "doc_id").filter("held_out").toPandas()
    assert len(rows) > 60 and (rows.predicted == rows.quality).mean() > 0.93
    assert rows.score.between(0, 1).all() and out.count() == docs.count()
    out.explain()
    assert "Python" not in capsys.readouterr().out


def test_compiled_column_equals_model(spark):
    r = np.random.default_rng(0)
    x = np.round(r.random((600, 3)), 2)
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.3) | (x[:, 2] > 0.9)).astype(float)
    m = quality.fit(x, y, ["a", "b", "c"])
    assert ((m.raw(x) > 0) == (y > 0)).mean() > 0.95 and 0 < len(m.rules) < 150
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double")
    got = df.select("a", "b", "c", m.column({c: F.col(c) for c in "abc"}).alias("p")).toPandas()
    assert np.allclose(got.p, 1 / (1 + np.exp(-m.raw(got[["a", "b", "c"]].to_numpy()))))


def test_cases(spark):
    docs = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (None, "x", "s"), (3, "a b " * 90_000, "s"), (3, "a", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (9, 5)], "doc_id long, quality int")
    held = lambda c: crc_mod(c, 3) == 1
    for lab in (labels, labels.limit(0), spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, quality int")):
        got = quality.report(docs, lab, held).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in got)
    assert quality.report(docs.limit(0), labels, held).count() == 0
