"""DuckDB SQL for the rows of the operators that plain SQL can express."""

from __future__ import annotations

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every 100-byte window by its first place; the others' bytes are joined to runs.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, p, md5(b[p : p + 99]) AS h FROM (SELECT doc_id, b, unnest(range(1, octet_length(b) - 98)) AS p FROM d)),
f AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
g AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM f),
i AS (SELECT doc_id, p, sum(CASE WHEN before IS NULL OR p > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM g),
s AS (SELECT doc_id, min(p) AS lo, max(p) + 100 AS hi FROM i GROUP BY doc_id, run),
k AS (
  SELECT doc_id, hi AS lo, coalesce(lead(lo) OVER (PARTITION BY doc_id ORDER BY lo), 1000000000000) AS hi FROM s
  UNION ALL SELECT doc_id, 1, min(lo) FROM s GROUP BY doc_id
),
t AS (SELECT k.doc_id, sha256(unhex(string_agg(hex(d.b[k.lo : least(k.hi - 1, octet_length(d.b))]), '' ORDER BY k.lo))) AS h FROM k JOIN d USING (doc_id) GROUP BY k.doc_id),
n AS (SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS gone, count(*) AS spans FROM s GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(spans, 0) AS n_spans, coalesce(t.h, sha256(b)) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""

#: Shared shingles of all pairs of distinct sets, then reachability.
NEAR_DEDUP = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda p: w[p] || ' ' || w[p + 1]))) END AS s FROM d),
c AS (SELECT s, min(doc_id) AS class_id, len(s) AS n FROM s WHERE len(s) > 0 GROUP BY s),
x AS (SELECT class_id, n, unnest(s) AS t FROM c),
p AS (SELECT a.class_id AS a, b.class_id AS b FROM x a JOIN x b ON a.t = b.t AND a.class_id < b.class_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(v, u) AS (SELECT class_id, class_id FROM c UNION SELECT e.b, r.u FROM r JOIN e ON r.v = e.a),
m AS (SELECT v AS class_id, min(u) AS u FROM r GROUP BY v)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(m.u, s.doc_id) AS component_id, coalesce(m.u, s.doc_id) = s.doc_id AS kept, c.class_id
FROM s LEFT JOIN c ON s.s = c.s LEFT JOIN m USING (class_id)
"""

#: Item windows joined with the documents' word sequences of the same lengths.
DECONTAMINATE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS k FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
g AS (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS k FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM i) WHERE len(w) >= n)),
h AS (SELECT r, n, p, item_id FROM g JOIN i USING (n, k)),
q AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS x FROM (SELECT DISTINCT r, n, p FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN q USING (r) LEFT JOIN t USING (r)
"""
