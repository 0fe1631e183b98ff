"""Extra columns whose names an operator uses for itself, repeated rows and blocks."""

import numpy as np
import pytest

import corpus_pipeline
from lattica.llm import decontaminate, language, near_dedup, suffix_dedup, vector_search

SF = "/root/testdata/sf0.001"
NAMES = ["__gone", "__key", "__n", "__runs", "__k", "__th", "__text", "__lang", "__score", "__shares", "__gain", "__spans", "__items", "__epoch", "__block", "__cells", "mix_epoch", "c0", "k", "th"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"the old house number {i % 3} stands by the river and the road to town " * 4, "en", "web", 60, *range(len(NAMES))) for i in range(30)]
    rows += [(None, None, None, None, None, *range(len(NAMES))), (4, rows[4][1], "en", "web", 60, *range(len(NAMES)))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"`{n}` int" for n in NAMES))


def test_operators(spark, docs):
    bench = spark.createDataFrame([("b", "the river and the road to town the old house")], "item_id string, text string")
    for out in (near_dedup.keep_one(docs), suffix_dedup.strip(docs), decontaminate.clean(docs, bench), language.identified(docs)):
        assert out.columns == docs.columns
        assert all(tuple(r[n] for n in NAMES) == tuple(range(len(NAMES))) for r in out.collect())


def test_stages(spark, docs):
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        assert out.columns[: len(docs.columns)] == docs.columns
        now = out if name != "mixing" else now
    assert out.columns[len(docs.columns) :] == ["mix_epoch_", "mix_block", "mix_position"]
    out.collect()


def test_stages_on_no_rows(spark, docs):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_a_row_repeated_a_thousand_times(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(7, text)] * 1000 + [(9, text + " thirteen"), (11, "nothing of the kind")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(df).collect()
    assert len(got) == 1002 and {(r.doc_id, r.component_id) for r in got} == {(7, 7), (9, 7), (11, 11)}


def test_blocks_of_the_benchmark_are_one_benchmark(spark):
    words = [f"w{i}" for i in range(400)]
    items = [(f"i{j}", " ".join(words[j * 10 : j * 10 + 14])) for j in range(30)] + [("s", "w5 w6 w7")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = [(i, " ".join(words[i * 7 : i * 7 + 40])) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(str, decontaminate.report(df, bench).collect()))
    assert sorted(map(str, decontaminate.report(df, bench, block_words=60).collect())) == whole


def test_blocks_of_queries_and_large_components(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    some = df.filter("vec_id % 10 = 0")
    whole = sorted(map(tuple, vector_search.top_k(some, df, 5).collect()))
    assert sorted(map(tuple, vector_search.top_k(some, df, 5, block_bytes=8 * 8 * 7).collect())) == whole and len(whole) == 250
    with pytest.raises(ValueError):
        vector_search.top_k(some, spark.createDataFrame([(1, [1e14])], "vec_id long, embedding array<double>").union(df), 5).collect()
