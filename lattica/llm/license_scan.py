"""License scan with a positional rare-token index of licence notices.

The index lists, for the rare words of each notice, where they stand in it.
Words are weighted by inverse document frequency over all documents (one pass that
counts the index's words alone, so the table stays as small as the index). Of each
notice the rarest words are indexed, as many as hold more than 1 - ``COVER`` of its
IDF: an alignment that covers ``COVER`` has one of them in place, so every notice of a
file is found, however many others stand in it. Each of their places in a file votes
by relative position (place in the file minus place in the notice). A voted alignment
covers the share of the notice's IDF that stands in place; from ``COVER`` on, and
if a mandatory key phrase of the notice stands in the aligned stretch, it is found.
Notices that lack a word of each of their key phrases in the file have no votes.

Base phrases are counted in every whole text, apart from the index. ``score`` is the
best cover among found notices, 1 where a base phrase stands, else 0.

Defined cases: null and empty texts have no words and no labels; an empty table
gives an empty result; all places of a word count, in texts of any length.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import binary, trimmed
from lattica.llm.decontaminate import words

BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
COVER, SLACK = 0.7, 3

#: label: (notice, mandatory key phrases of which one must stand). Short forms as files carry them.
NOTICES = [
    ("mit", "released under the MIT license", ["mit license"]),
    ("mit", "licensed under the MIT license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ["permission is hereby granted free of charge"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ["use copy modify and or distribute"]),
    ("isc", "released under the ISC license", ["isc license"]),
    ("apache-2.0", "licensed under the Apache license version 2 0", ["apache license version 2 0"]),
    ("apache-2.0", "SPDX license identifier Apache 2 0", ["apache 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification", ["source and binary forms"]),
    ("bsd", "released under the BSD license", ["bsd license"]),
    ("bsd", "licensed under the 3 clause BSD license", ["bsd license"]),
    ("gpl-3.0", "this work is licensed under the GNU general public license version 3", ["general public license version 3"]),
    ("gpl-2.0", "this work is licensed under the GNU general public license version 2", ["general public license version 2"]),
    ("gpl-3.0", "licensed under the GNU GPL version 3", ["gpl version 3"]),
    ("lgpl", "licensed under the GNU lesser general public license", ["lesser general public license"]),
    ("agpl-3.0", "licensed under the GNU affero general public license version 3", ["affero general public license"]),
    ("mpl-2.0", "subject to the terms of the Mozilla public license v 2 0", ["mozilla public license"]),
    ("epl-2.0", "made available under the terms of the Eclipse public license 2 0", ["eclipse public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"]),
    ("cc0-1.0", "to the extent possible under law CC0 1 0 universal", ["cc0 1 0"]),
    ("cc-by-4.0", "licensed under CC BY 4 0", ["cc by 4 0"]),
    ("cc-by-sa-4.0", "licensed under CC BY SA 4 0", ["cc by sa 4 0"]),
    ("cc-by-nc-4.0", "licensed under CC BY NC 4 0", ["cc by nc 4 0"]),
    ("cc-by-nd-4.0", "licensed under CC BY ND 4 0", ["cc by nd 4 0"]),
    ("cc-by-4.0", "licensed under a Creative Commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    # clauses that tell the licence when its whole text stands in a file, each a notice of its own, as names filled in between them move what follows
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["copies or substantial portions of the software"]),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["deal in the software without restriction"]),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ["redistributions of source code must retain"]),
    ("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ["redistributions in binary form must reproduce"]),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["used to endorse or promote products derived from this software"]),
    ("isc", "provided that the above copyright notice and this permission notice appear in all copies", ["permission notice appear in all copies"]),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions", ["alter it and redistribute it freely"]),
    ("zlib", "the origin of this software must not be misrepresented you must not claim that you wrote the original software", ["must not claim that you wrote the original software"]),
    ("bsl-1.0", "distributed under the Boost software license version 1 0", ["boost software license"]),
    ("bsl-1.0", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ["any person or organization obtaining a copy"]),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ["apache org licenses license 2 0"]),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ["without warranties or conditions of any kind"]),
    ("gpl-3.0", "you can redistribute it and or modify it under the terms of the GNU general public license as published by the free software foundation either version 3 of the license or at your option any later version", ["either version 3 of the license"]),
    ("gpl-2.0", "you can redistribute it and or modify it under the terms of the GNU general public license as published by the free software foundation either version 2 of the license or at your option any later version", ["either version 2 of the license"]),
    ("lgpl", "you can redistribute it and or modify it under the terms of the GNU lesser general public license as published by the free software foundation", ["lesser general public license as published"]),
    ("agpl-3.0", "you can redistribute it and or modify it under the terms of the GNU affero general public license as published by the free software foundation", ["affero general public license as published"]),
    ("mpl-2.0", "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0", ["copy of the mpl was not distributed with this file"]),
    ("epl-2.0", "which is available at https www eclipse org legal epl 2 0", ["eclipse org legal epl 2 0"]),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", ["source code form or as a compiled binary"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["copyright and related or neighboring rights to this"]),
]

#: Templates of a caller's own table, bounded because they are sent to every worker.
MAX_TEMPLATES, MAX_TEMPLATE_BYTES = 20_000, 64 << 20


class Index:
    def __init__(self, notices, df: dict[bytes, int], n_docs: int):
        self.notices = [(label, words(text.encode()), [b" " + b" ".join(words(k.encode())) + b" " for k in keys]) for label, text, keys in notices]
        vocab = {w for _, ws, _ in self.notices for w in ws}
        self.idf = {w: math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 0.1 for w in vocab}
        self.mass = [sum(self.idf[w] for w in ws) for _, ws, _ in self.notices]
        self.needed = [[set(k.split()) for k in keys] for _, _, keys in self.notices]
        self.rare: list[list[tuple[bytes, int]]] = []  # by notice: the words of which one must stand in place
        for (_, ws, _), mass in zip(self.notices, self.mass, strict=True):
            held, rare = 0.0, []
            for q in sorted(range(len(ws)), key=lambda q: (-self.idf[ws[q]], q)):
                if held > (1 - COVER + 1e-9) * mass:
                    break
                held += self.idf[ws[q]]
                rare.append((ws[q], q))
            self.rare.append(rare)

    def scan(self, ws: list[bytes]) -> dict[str, float]:
        """Labels of the notices found, with their cover."""
        present = self.idf.keys() & set(ws)
        asked = [t for t, needed in enumerate(self.needed) if any(k <= present for k in needed)]
        if not asked:
            return {}
        places: dict[bytes, list[int]] = {w: [] for t in asked for w, _ in self.rare[t]}
        for i, w in enumerate(ws):
            if w in places:
                places[w].append(i)
        found: dict[str, float] = {}
        voted = {(t, p - q) for t in asked for w, q in self.rare[t] for p in places[w]}
        for t, at in voted:
            label, notice, keys = self.notices[t]
            n = len(ws)
            cover = sum(self.idf[w] for q, w in enumerate(notice) if 0 <= at + q < n and ws[at + q] == w) / self.mass[t]
            if cover >= COVER and cover > found.get(label, 0):
                near = b" " + b" ".join(ws[max(0, at - SLACK) : at + len(notice) + SLACK]) + b" "
                if any(k in near for k in keys):
                    found[label] = cover
        return found


def base_places(ws: list[bytes]) -> list[tuple[int, str]]:
    """(start, label) of every base phrase."""
    joined = b" " + b" ".join(ws) + b" "
    out = []
    for phrase, label in BASE.items():
        p = f" {phrase} ".encode()
        i, last, at = joined.find(p), 0, -1
        while i >= 0:
            at += joined.count(b" ", last, i + 1)
            out.append((at, label))
            last, i = i + 1, joined.find(p, i + 1)
    return sorted(out)


def build(docs: DataFrame, notices=NOTICES) -> Index:
    """The index, weighted over all of docs (text)."""
    vocab = {w for _, text, _ in notices for w in words(text.encode())}

    def count(batches):
        df, n = dict.fromkeys(vocab, 0), 0
        for batch in batches:
            for b in binary(batch.column(0)):
                n += 1
                for w in vocab.intersection(words(b)):
                    df[w] += 1
        rows = [("", n), *((w.decode(), c) for w, c in df.items() if c)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["w", "n"])

    got = {r.w: r.n for r in docs.select("text").mapInArrow(trimmed(count), "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return Index(notices, {w.encode(): c for w, c in got.items()}, got.get("", 0))


def notices_of(templates: DataFrame) -> list[tuple[str, str, list[str]]]:
    """NOTICES from a table (label, text, keys array<string>) of templates.

    Rows with a null label or text, or a text without words, are left out; null or
    wordless keys stand for the whole text as its own key phrase. Over
    MAX_TEMPLATES rows or MAX_TEMPLATE_BYTES of text is an error: nothing is dropped.
    """
    rows = templates.select("label", "text", "keys").filter("label is not null and text is not null").distinct()
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    if size.n > MAX_TEMPLATES or size.b > MAX_TEMPLATE_BYTES:
        raise ValueError(f"{size.n} templates of {size.b} bytes; at most {MAX_TEMPLATES} of {MAX_TEMPLATE_BYTES} bytes can be sent to every worker")
    worded = lambda keys: [k for k in keys or () if k and words(k.encode())]
    return sorted((r.label, r.text, worded(r["keys"]) or [r.text]) for r in rows.collect() if words(r.text.encode()))


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def report(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """Per document: the columns of SCHEMA."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(build(docs, notices))

    def fn(batches):
        index = shared.value
        for batch in batches:
            out = []
            for b in binary(batch.column(1)):
                ws = words(b)
                base = base_places(ws)
                found = index.scan(ws)
                own = sorted({x for _, x in base})
                out.append((len(ws), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(own), ",".join(sorted({*own, *found})), min(1.0, max([0.0, *found.values(), *[1.0] * bool(base)]))))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.mapInArrow(trimmed(fn), SCHEMA)
