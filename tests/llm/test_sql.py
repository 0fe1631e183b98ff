"""The operators' SQL against the same brute-force versions as the operators."""

import duckdb
import test_decontaminate as windows
import test_near_dedup as copies
import test_suffix_dedup as repeats

from lattica.llm import sql


def run(query, docs, items=()):
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.execute("create table benchmark (item_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", docs)
    if items:
        db.executemany("insert into benchmark values (?, ?)", items)
    return db.execute(query).fetchall()


def test_repeats():
    rows = [r for r in repeats.texts() if len(r[1] or "") < 50_000]  # the SQL cuts windows from whole texts, quadratic in their length
    assert {r[0]: r[1:] for r in run(sql.SUFFIX_DEDUP, rows)} == repeats.brute(rows)


def test_copies():
    rows = copies.rows()
    assert {r[0]: r[1:4] for r in run(sql.NEAR_DEDUP, rows)} == copies.brute(rows)


def test_windows():
    docs, items = windows.data(2, True)
    assert {r[0]: r[1:] for r in run(sql.DECONTAMINATE, docs, items)} == windows.brute(docs, items)
