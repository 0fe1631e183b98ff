import random

import corpus_pipeline


def test_stages_take_effect(spark, tmp_path):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item, shared = prose(30), prose(60)
    rows = [(i, prose(150), "en") for i in range(60)]
    copy = rows[3][1].split()
    copy[10] = "changed"
    rows += [(60, " ".join(copy), "en"), (61, rows[4][1], "en"), (62, None, None), (63, "12 34", "en"), (64, "", "en")]
    rows += [(70 + i, f"{prose(80)} {shared} {prose(50)}", "en") for i in range(3)]
    rows += [(80, f"{prose(100)} {item} {prose(20)}", "en"), (81, item, "en")]
    docs = spark.createDataFrame([(k, t, lang, f"s{k % 3}", len(t or "")) for k, t, lang in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, str(tmp_path))
        if name != "mixing":
            assert out.columns == docs.columns
        seen[name] = {x.doc_id: x.text for x in out.collect()}
    clean = set(range(60))
    assert set(seen["language"]) == {k for k, _, _ in rows} - {62, 63, 64}
    assert set(seen["near_dedup"]) == set(seen["language"]) - {60, 61}
    assert sum(shared[10:-10] in t for t in seen["suffix_dedup"].values()) == 1
    assert 81 not in seen["decontaminate"] and item[5:-5] not in seen["decontaminate"][80]
    assert all(seen["decontaminate"][k] == dict((a, b) for a, b, _ in rows)[k] for k in clean)
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {"mix_epoch", "mix_block", "mix_position"} <= set(got.columns) and {x.doc_id for x in got.collect()} <= set(seen["decontaminate"])
