"""Graph algorithms over customers and suppliers, nations, and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica import Matrix, Scalar
from lattica.functions.dtypes import FP64, INT64
from lattica.operators.collection import pieces, spread
from lattica.plans import graph
from lattica.queries.algebra import VIEWS, nn, read, sp
from lattica.sources import io

QUERIES, ORACLE = {}, {}
PARTS = 1 << 24


def lower(lines) -> Matrix:
    """Parts that stand in one order, the larger first, by how many pairs of lines join them; written once."""
    pairs = lines.join(lines.withColumnRenamed("p", "r"), "l_orderkey").where("p > r")
    return Matrix.from_df(pairs, "p", "r", F.lit(1).cast("long"), dtype=INT64, shape=(PARTS, PARTS), dup_op="plus", sparse=True).checkpoint()


def parts_of_orders(spark, d):
    """Lines by hash of their order: a task's share does not grow with the table."""
    lines = read(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p"))
    return spread(lines, pieces(lines), "l_orderkey")


def together(spark, d) -> Matrix:
    """The undirected graph of parts that stand in one order: the half that is written, and its mirror."""
    return mirrored(lower(parts_of_orders(spark, d)))


def mirrored(half: Matrix) -> Matrix:
    return Matrix.of(half.df.union(half.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")), INT64, half.shape)


TOGETHER = "hv AS (SELECT CAST(a.l_partkey AS BIGINT) AS i, CAST(b.l_partkey AS BIGINT) AS j, count(*) AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2)"
#: Rounds that the SQL's loops may take: no shortest path of the test tables has as many edges.
DEEP = 12


def q(name, fn, sql):
    QUERIES[name] = lambda spark, d: fn(spark, d).df
    ORACLE[name] = sql


def cosupply(spark, d):
    """Suppliers by the number of others that supply a part in common: the flagship query.

    There are as many pairs as a part has suppliers, squared; hot parts are left to the skew join.
    """
    return graph.overlaps(sp(spark, d))


q("cosupply", cosupply, f"WITH s AS ({VIEWS['sp']}) SELECT i, count(*) AS v FROM (SELECT DISTINCT a.i, b.i AS k FROM s a JOIN s b ON a.j = b.j) GROUP BY i")
_LEVELS = f"WITH RECURSIVE {TOGETHER}, w(i, l) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION SELECT h.j, w.l + 1 FROM w JOIN hv h ON w.i = h.i WHERE w.l < {DEEP}), lv AS (SELECT i, min(l) AS v FROM w GROUP BY i)"
q("bfs_levels", lambda s, d: graph.bfs_levels(together(s, d), 1), f"{_LEVELS} SELECT i, v FROM lv")
q("bfs_parents", lambda s, d: graph.bfs_parents(together(s, d), 1), f"{_LEVELS} SELECT CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS v UNION ALL SELECT b.i, min(a.i) FROM lv b JOIN hv h ON h.j = b.i JOIN lv a ON a.i = h.i AND a.v = b.v - 1 GROUP BY b.i")
q("sssp", lambda s, d: graph.sssp(together(s, d), 1), f"WITH RECURSIVE {TOGETHER}, w(i, n, l) AS (SELECT CAST(1 AS BIGINT), 0, CAST(0 AS DOUBLE) UNION ALL SELECT i, n, min(l) FROM (SELECT h.j AS i, w.n + 1 AS n, w.l + h.v AS l FROM w JOIN hv h ON w.i = h.i WHERE w.n < {DEEP}) GROUP BY i, n) SELECT i, min(l) AS v FROM w GROUP BY i")
_START = "SELECT DISTINCT i, 0 AS n, i AS r FROM hv"


def components(spark, d):
    """Components of parts through orders: each order's parts linked to its smallest one join the same parts as all its pairs."""
    lines = parts_of_orders(spark, d)
    stars = lines.join(lines.groupBy("l_orderkey").agg(F.min("p").alias("r")), "l_orderkey").where("p > r")
    f = graph.connected_components(Matrix.from_df(stars, "p", "r", F.lit(True), shape=(PARTS, PARTS), dup_op="any", sparse=True).checkpoint(), isolated=False)
    return type(f).of(f.df, INT64, f.shape)


q("connected_components", components, f"WITH RECURSIVE {TOGETHER}, w(i, n, r) AS ({_START} UNION ALL SELECT i, n, min(r) FROM (SELECT h.j AS i, w.n + 1 AS n, least(w.r, h.j) AS r FROM w JOIN hv h ON w.i = h.i WHERE w.n < {DEEP}) GROUP BY i, n) SELECT i, min(r) AS v FROM w GROUP BY i")


def triangle_count(spark, d):
    return Scalar.of(graph.triangle_total(lower(parts_of_orders(spark, d))), INT64, ())


q("triangle_count", triangle_count, f"WITH {TOGETHER}, e AS (SELECT i AS a, j AS b FROM hv WHERE i > j) SELECT CAST(count(*) AS BIGINT) AS v FROM e x JOIN e y ON x.a = y.a JOIN e z ON z.a = x.b AND z.b = y.b")


def ranked_parts(spark, d) -> Matrix:
    """The graph with its vertices numbered densely, as ranks are shares over all vertices; lines are numbered before they are paired."""
    lines = parts_of_orders(spark, d)
    lines = lines.join(lines.groupBy("l_orderkey").agg(F.min("p").alias("least"), F.max("p").alias("most")).where("least < most"), "l_orderkey").select("l_orderkey", "p")
    ids = io.dictionary(lines.withColumnRenamed("p", "old"), "old")
    a = mirrored(lower(lines.join(ids, F.col("p") == F.col("old")).select("l_orderkey", F.col("id").alias("p"))))
    n = ids.count()
    return Matrix.of(a.df, INT64, (n, n))


def pagerank(spark, d):
    r = graph.pagerank(ranked_parts(spark, d), iterations=3)
    return type(r).of(r.df.withColumn("v", F.round("v", 12)), FP64, r.shape)


_STEP = "SELECT n.i, 0.15::DOUBLE / n.c + 0.85::DOUBLE * coalesce(g.v, 0) AS v FROM ids n LEFT JOIN (SELECT h.j AS i, sum(r.v / dg.c) AS v FROM r{0} r JOIN dg ON dg.i = r.i JOIN gg h ON h.i = r.i GROUP BY h.j) g ON g.i = n.i"
q("pagerank_3", pagerank, f"WITH {TOGETHER}, ids AS (SELECT old, row_number() OVER (ORDER BY old) - 1 AS i, CAST(count(*) OVER () AS DOUBLE) AS c FROM (SELECT DISTINCT i AS old FROM hv)), gg AS (SELECT a.i, b.i AS j FROM hv JOIN ids a ON a.old = hv.i JOIN ids b ON b.old = hv.j), dg AS (SELECT i, CAST(count(*) AS DOUBLE) AS c FROM gg GROUP BY i), "
  f"r0 AS (SELECT i, 1.0::DOUBLE / c AS v FROM ids), r1 AS ({_STEP.format(0)}), r2 AS ({_STEP.format(1)}), r3 AS ({_STEP.format(2)}) SELECT i, round(v, 12) AS v FROM r3")  # fmt: skip


def regions(spark, d):
    """Communities of the nations by the orders between them, both ways added up."""
    a = nn(spark, d)
    both = a.df.union(a.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return graph.louvain(Matrix.from_df(both, "i", "j", F.col("v"), dtype=INT64, shape=a.shape, dup_op="plus"))


#: Louvain has no SQL and many passes; tests compare its modularity with that of all partitions of small graphs.
QUERIES["louvain"] = lambda s, d: regions(s, d).df


def user_events(spark, d):
    """Users by event types: string keys become dense ids."""
    a, _, _ = io.from_keys(read(spark, d, "events"), "user_id", "event_type", F.col("value"), dup_op="max")
    return a


q("from_keys", user_events, "SELECT dense_rank() OVER (ORDER BY user_id) - 1 AS i, dense_rank() OVER (ORDER BY event_type) - 1 AS j, v FROM (SELECT user_id, event_type, max(value) AS v FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2)")
