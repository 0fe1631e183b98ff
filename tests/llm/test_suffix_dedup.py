import hashlib
import random

from lattica.llm import suffix_dedup


def brute(rows, length=100):
    """rows: (doc_id, text), doc_ids distinct."""
    seen, out = set(), {}
    for k, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if (w := b[i : i + length]) in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(w)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out[k] = (len(b), sum(gone), len(bytes(gone).replace(b"\x00", b" ").split()), hashlib.sha256(kept).hexdigest())
    return out


def texts():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    common = [prose(40) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "a" * 500), (4, "ab" * 300), (5, "a" * 100), (6, "x" + "a" * 99)]
    for i in range(7, 80):
        parts = [prose(r.randint(0, 60))]
        for _ in range(r.randint(0, 3)):
            c = r.choice(common)
            lo = r.randint(0, 60)
            parts += [c[lo : lo + r.randint(60, 220)], prose(r.randint(0, 20))]
        rows.append((i, " ".join(parts)))
    rows += [(200 + i, rows[20][1]) for i in range(5)]
    rows.append((300, prose(90_000) + common[0]))  # several pieces
    return rows


def test_against_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame([(k, t, "x", 7) for k, t in rows], "doc_id long, text string, k string, runs int").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.report(df).collect()}
    assert got == brute(rows)


def test_repeated_rows_null_ids_and_empty(spark):
    t = "the quick brown fox " * 4 + "jumps over the lazy dog " * 4
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t + "!")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_removed) for r in suffix_dedup.report(df).collect())
    own = brute([(0, t)])[0][1]  # what the text repeats of itself
    assert got[0] == (-1, own) and got[1] == got[2] == (1, len(t)) and got[3][1] == len(t)
    assert suffix_dedup.report(df.limit(0)).count() == 0


def test_strip_keeps_characters_and_columns(spark):
    a = "é" * 120
    df = spark.createDataFrame([(1, a + "x", "en", "s", 1), (2, "q" + a, "en", "s", 1), (3, a, "en", "s", 1), (4, "clean", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in suffix_dedup.strip(df).collect()}
    assert set(got) == {1, 2, 4} and got[4].text == "clean" and got[2].text.startswith("q") and got[2].n_chars == len(got[2].text)
