from pyspark.sql import functions as F

from lattica.llm import language
from lattica.llm.common import crc_mod

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.report(docs, crc_mod("doc_id", 4) == 2).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    n, right = got.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 200 and right / n > 0.97


def test_cases(spark):
    rows = [(i, "the cat and the dog of the house with them " * 3, "en") for i in range(40)] + [(100 + i, "der hund und die katze mit dem haus ist nicht " * 3, "de") for i in range(40)]
    rows += [(500, None, "en"), (501, "", None), (502, "123 !!! ___", "de"), (503, "the cat and the dog with them der hund und die katze mit dem haus" * 4, None), (504, "q", None), (None, "the dog", "en"), (500, None, "en"), (505, "Ж", None), (506, "the dog and " * 20_000, None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in language.report(df, crc_mod("doc_id", 4) == 2).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (500, 501, 502))
    assert set(got[503].shares) == {"en", "de"} and 0.3 < got[503].shares["en"] < 0.7
    assert got[504].lang_pred in ("en", "de") and got[505].lang_pred in ("en", "de") and got[506].lang_pred == "en" and not got[None].held_out
    assert language.identified(df).count() == len(rows) - 4
    assert language.identified(df.withColumn("lang", F.lit(None).cast("string"))).count() == len(rows) - 4
    assert language.report(df.limit(0), crc_mod("doc_id", 4) == 2).count() == 0


def test_em_recovers_proportions():
    import numpy as np

    r = np.random.default_rng(1)
    p = r.dirichlet(np.full(300, 0.1), 3).T + 1e-9
    p /= p.sum(axis=0)
    w = np.round(1e5 * (p @ [0.6, 0.3, 0.1]))
    share, _ = language._em(p, w, 200)
    assert abs(share - [0.6, 0.3, 0.1]).max() < 0.02


def test_letters_and_nonsense(spark):
    rows = [(i, "the cat and the dog of the house with them " * 3, "en") for i in range(40)] + [(100 + i, "der hund und die katze mit dem haus ist nicht " * 3, "de") for i in range(40)]
    rows += [(500, "² ½ 123", "en"), (501, "zqxj vkwq xzjq qvkx jjqz " * 30, None), (502, "the cat with the dog", None)]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "doc_id long, text string, lang string, __lang int, __gain double")
    got = {r.doc_id: r for r in language.report(df.select("doc_id", "text", "lang"), crc_mod("doc_id", 4) == 2).collect()}
    assert got[500].lang_pred == "und" and got[501].lang_pred in ("en", "de")
    kept = language.identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(40)) | set(range(100, 140)) | {502}


def test_more_languages_than_one_document_mixes(spark):
    words = [f"{c}{v}{c}{w}" for c in "bdfgklmnprst" for v in "ae" for w in "io"]
    rows = [(i * 20 + j, " ".join(words[4 * i : 4 * i + 4] * 6), f"l{i:02d}") for i in range(12) for j in range(12)]
    rows.append((10_000, " ".join(w for i in range(10) for w in words[4 * i : 4 * i + 4] * 12), None))
    got = {r.doc_id: r for r in language.report(spark.createDataFrame(rows, "doc_id long, text string, lang string"), crc_mod("doc_id", 4) == 2).collect()}
    assert set(got[10_000].shares) == {f"l{i:02d}" for i in range(10)}
