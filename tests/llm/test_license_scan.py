import random
import re

from lattica.llm import license_scan as scan

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def brute(text):
    w = WORD.findall((text or "").encode().lower())
    at = [(i, label) for p, label in scan.BASE.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.encode().split()]
    return (len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at})))


def test_base_against_brute_force_and_notices(spark):
    r = random.Random(2)
    pool = ["cc", "by", "all", "rights", "reserved", "General", "PUBLIC", "license", "x", "é", "CC-BY", "mit"]
    rows = [(i, " ".join(r.choice(pool) for _ in range(r.randint(0, 40)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "Released under the MIT License."), (1003, "so\nLicensed under the Apache License, Version 2.0."), (1004, "x " * 50_000 + "Licensed under CC BY-NC 4.0. cc by cc by"),
             (1005, "This work is licensed under the GNU General Public License, version 3."), (1006, "the license of the work is under version 2"), (1007, "Permission is hereby granted, free of charge, to any person obtaining a copy of it"), (1002, "Released under the MIT License.")]
    df = spark.createDataFrame([(*x, "y") for x in rows], "doc_id long, text string, labels string")
    got = {x.doc_id: x for x in scan.report(df).collect()}
    for k, t in rows:
        assert (got[k].n_words, got[k].n_base, got[k].first_word, got[k].last_word, got[k].base_labels) == brute(t), t
        assert set(filter(None, got[k].base_labels.split(","))) <= set(filter(None, got[k].labels.split(","))) and 0 <= got[k].score <= 1
    assert [got[k].labels for k in range(1000, 1008)] == ["", "", "mit", "apache-2.0", "cc-by,cc-by-nc-4.0", "gpl,gpl-3.0", "", "mit"]
    assert scan.report(df.limit(0)).count() == 0 and scan.report(df).count() == len(rows)


def test_every_notice_of_a_file(spark):
    notices = [(label, text) for label, text, _ in scan.NOTICES]
    grant, bsd, free, apache = (next(t for label, t in notices if label == x and t.startswith(y)) for x, y in (("mit", "permission"), ("bsd", "redis"), ("unlicense", "this"), ("apache-2.0", "licensed")))
    every = ". ".join(t for _, t in notices)
    vocabulary = " or ".join(sorted({w for _, t in notices for w in t.split()}))
    rows = [(1, f"{grant}. {bsd}. {free}. {apache}."), (2, every), (3, f"{vocabulary}\n{apache}"), (4, vocabulary)] + [(n, "this work is licensed under the license") for n in range(10, 60)]
    got = {x.doc_id: x.labels.split(",") for x in scan.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == ["apache-2.0", "bsd", "mit", "unlicense"]
    assert set(got[2]) >= {label for label, _ in notices}
    assert "apache-2.0" in got[3] and "apache-2.0" not in got[4]


def test_scan_is_exhaustive():
    r = random.Random(5)
    vocab = sorted({w for _, t, _ in scan.NOTICES for w in scan.words(t.encode())})
    index = scan.Index(scan.NOTICES, {w: r.randint(0, 900) for w in vocab}, 1000)
    for _ in range(60):
        ws = []
        for _ in range(r.randint(1, 9)):
            notice = [w if r.random() < 0.93 else b"x" for w in r.choice(index.notices)[1]]
            ws += notice + [r.choice([*vocab, b"y"]) for _ in range(r.randint(0, 9))]
        want = {}
        for t, (label, notice, keys) in enumerate(index.notices):
            for at in range(-len(notice), len(ws)):
                cover = sum(index.idf[w] for q, w in enumerate(notice) if 0 <= at + q < len(ws) and ws[at + q] == w) / index.mass[t]
                near = b" " + b" ".join(ws[max(0, at - scan.SLACK) : at + len(notice) + scan.SLACK]) + b" "
                if cover >= scan.COVER and any(k in near for k in keys):
                    want[label] = max(want.get(label, 0), cover)
        assert index.scan(ws) == want


MIT = """Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that:
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
   products derived from this software without specific prior written permission."""
ZLIB = """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to
alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software."""
GPL = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""
MPL = "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


def test_clauses_of_whole_licences(spark):
    plain = "the software that anyone may copy, modify and sell; the rights of the author and of any person are granted in the license"
    rows = [(1, MIT), (2, BSD), (3, ZLIB), (4, GPL), (5, MPL), (6, MIT + GPL), (7, plain)]
    got = {x.doc_id: x.labels for x in scan.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "bsd,bsd-3-clause", 3: "zlib", 4: "gpl,gpl-2.0", 5: "mpl-2.0", 6: "gpl,gpl-2.0,mit", 7: ""}


def test_notices_of_a_table(spark):
    rows = [("own", "use it as the owner of the brook allows", ["owner of the brook"]), ("own", "use it as the owner of the brook allows", ["owner of the brook"]), ("whole", "Take what the meadow gives", None), ("whole", "Leave what the meadow keeps", ["..."]), (None, "x", None), ("y", None, None), ("z", "...", ["..."])]
    table = spark.createDataFrame(rows, "label string, text string, keys array<string>")
    notices = scan.notices_of(table)
    assert [x[0] for x in notices] == ["own", "whole", "whole"]
    docs = spark.createDataFrame([(1, "so: use it, as the owner of the brook allows!"), (2, "take what the meadow gives"), (3, "the owner of the meadow")], "doc_id long, text string")
    assert {x.doc_id: x.labels for x in scan.report(docs, notices).collect()} == {1: "own", 2: "whole", 3: ""}
    assert scan.notices_of(table.limit(0)) == []
