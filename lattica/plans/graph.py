"""BFS, shortest paths, PageRank, components, triangles and Louvain.

Loops read the adjacency matrix again each round, write their small state to the checkpoint
folder (a lost executor costs one round) and test for convergence with one small action.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lattica.functions.dtypes import BOOL, FP64, INT64
from lattica.operators.collection import Matrix, Vector, pieces, spread, stored


def bfs_levels(a: Matrix, source: int, max_level: int | None = None) -> Vector:
    """Level of every reachable vertex, the source at 1."""
    level = Vector.from_coo([source], [1], INT64, size=a.nrows)
    front, n = Vector.from_coo([source], [True], BOOL, size=a.nrows), 1
    one = Matrix.of(a.df.select("i", "j", F.lit(True).alias("v")), BOOL, a.shape)
    while max_level is None or n < max_level:
        n += 1
        front(~level.S, replace=True) << front.vxm(one, "any_pair")
        front.checkpoint()
        if not front.df.head(1):
            break
        level(front.S) << n
        level.checkpoint()
    return level


def bfs_parents(a: Matrix, source: int) -> Vector:
    """The smallest parent on the level before; the source is its own."""
    parent = Vector.from_coo([source], [source], INT64, size=a.nrows)
    front = parent.dup()
    one = Matrix.of(a.df.select("i", "j", F.lit(1).cast("long").alias("v")), INT64, a.shape)
    while True:
        front << front.apply("positioni")
        front(~parent.S, replace=True) << front.vxm(one, "min_first")
        front.checkpoint()
        if not front.df.head(1):
            return parent
        parent(front.S) << front
        parent.checkpoint()


def sssp(a: Matrix, source: int) -> Vector:
    """Shortest distances by relaxation to a fixed point; a round relaxes only from vertices that came nearer."""
    a = a.dup(FP64)
    d = Vector.from_coo([source], [0.0], FP64, size=a.nrows)
    near = d
    while True:
        got = near.vxm(a, "min_plus").new().df.withColumnRenamed("v", "w")
        both = d.df.join(got, "i", "full").select("i", F.least("v", "w").alias("v"), (F.col("v").isNull() | (F.col("w") < F.col("v"))).alias("moved"))
        both = stored(both)
        d = Vector.of(both.select("i", "v"), FP64, d.shape)
        near = Vector.of(both.where("moved").select("i", "v"), FP64, d.shape)
        if not near.df.head(1):
            return d


def pagerank(a: Matrix, damping: float = 0.85, iterations: int | None = None, tol: float = 1e-6, max_iterations: int = 100) -> Vector:
    """Ranks that sum to 1; vertices without out-links give to all.

    Each vertex's out-links are written once as a list, which a round joins with the ranks.
    """
    n = a.nrows
    j = F.col("j").cast("int") if a.ncols < 1 << 31 else F.col("j")
    links = stored(spread(a.df.select("i", j.alias("j")), pieces(a.df), "i").groupBy("i").agg(F.collect_list("j").alias("to")))
    parts, linked = pieces(links), links.count() == n  # then no round has to look for sinks
    r = Vector.from_scalar(1.0 / n, n)
    for _ in range(iterations or max_iterations):
        old = r
        share = old.df.join(spread(links, parts, "i"), "i").select((F.col("v") / F.size("to")).alias("x"), F.explode("to").alias("i"))
        sinks = 0.0 if linked else old.df.join(links, "i", "left_anti").agg(F.sum("v")).first()[0] or 0.0
        base = (1 - damping) / n + damping * sinks / n
        got = share.groupBy("i").agg(F.sum("x").alias("v")).select(F.col("i").cast("long").alias("i"), "v")
        df = old.df.select("i").join(got, "i", "left").select("i", (F.lit(base) + damping * F.coalesce("v", F.lit(0.0))).alias("v"))
        r = Vector.of(df, FP64, (n,)).checkpoint()
        if iterations is None and (r.df.withColumnRenamed("v", "w").join(old.df, "i").agg(F.sum(F.abs(F.col("w") - F.col("v")))).first()[0] or 0) < tol * n:
            break
    return r


def connected_components(a: Matrix, isolated: bool = True) -> Vector:
    """The smallest vertex of each vertex's component; edges count both ways.

    A round hooks every vertex to its smallest neighbour, jumps along the hooks until all point
    at roots and joins each tree into its root, so at least half of the linked vertices go; rounds
    end when no edge is left. Isolated vertices are their own components (left out unless
    ``isolated``, which fills the shape).
    """
    n = pieces(a.df)
    lo, hi = F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j")
    g = a.df.where("i <> j").select(lo, hi)
    ends = lambda g: g.select("i", F.col("j").alias("w")).union(g.select(F.col("j").alias("i"), F.col("i").alias("w")))
    f = None
    while True:
        m = stored(ends(g).groupBy("i").agg(F.min("w").alias("w")).select("i", F.least("i", "w").alias("v")))
        if not m.head(1):
            break
        while m.where("i <> v").head(1):
            jump = m.select(F.col("i").alias("v"), F.col("v").alias("w"))
            far = stored(m.join(jump, "v").select("i", F.col("w").alias("v"), (F.col("w") < F.col("v")).alias("moved")))
            m = far.select("i", "v")
            if not far.where("moved").head(1):
                break
        root = m.select(F.col("i").alias("j"), F.col("v").alias("w"))
        g = spread(spread(g, n, "i").join(m, "i").select(F.col("v").alias("i"), "j"), n, "j").join(root, "j").select("i", F.col("w").alias("j"))
        g = stored(g.where("i <> j").select(lo, hi).distinct())
        n = pieces(g)
        f = m if f is None else stored(f.join(m.select(F.col("i").alias("v"), F.col("v").alias("w")), "v", "left").select("i", F.coalesce("w", "v").alias("v")))
    alone = a.df.where("i = j").select("i", F.col("j").alias("v")).distinct()
    f = alone if f is None else f.union(alone.join(f, "i", "left_anti"))
    if isolated:
        every = Vector.of(None, INT64, (a.nrows,)).dense_coords()
        f = every.join(f, "i", "left").select("i", F.coalesce("v", "i").alias("v"))
    return Vector.of(f, INT64, (a.nrows,))


def overlaps(a: Matrix) -> Vector:
    """How many rows have a column in common with each row, itself included: a @ a.T by any_pair, counted.

    A column's rows go as one list to each of them, and a row's lists meet in one task, which tells
    its partners apart: no pair of rows is exchanged as a row of its own.
    """
    e = a.df.select("i", "j")
    lists = e.groupBy("j").agg(F.collect_list(F.col("i").cast("int") if a.nrows < 1 << 31 else F.col("i")).alias("ks"))
    met = e.join(lists, "j").select("i", "ks")
    n = pieces(a.df)
    met = spread(met, n, "i") if n else met.repartition("i")
    pairs = met.select("i", F.explode("ks").alias("k")).distinct()
    return Vector.of(pairs.groupBy("i").agg(F.count(F.lit(1)).alias("v")), INT64, (a.nrows,))


#: Edges that one task of the triangle count may hold, the fine ranges of vertices and the most ranges they are joined into.
TASK_EDGES, FINE, MOST = 4_000_000, 1024, 128


def _blocks(fine: np.ndarray, p: int):
    """Bounds of p ranges of vertices with about as many edges each, and the edges from range to range."""
    ends = fine.sum(0) + fine.sum(1)
    total = np.cumsum(ends)
    own = np.minimum((total - ends / 2) * p // max(total[-1], 1), p - 1).astype(int)
    into = np.zeros((len(fine), p))
    into[np.arange(len(fine)), own] = 1
    return own, into.T @ fine @ into


def _triples(c: np.ndarray):
    """Ranges (z, y, x), z <= y <= x, that edges join in all three ways, and the edges of each."""
    p = len(c)
    out = []
    for x in range(p):
        for y in range(x + 1):
            if c[x, y]:
                for z in np.flatnonzero((c[x, : y + 1] > 0) & (c[y, : y + 1] > 0)):
                    out.append((int(z), y, x, sum(c[k] for k in {(x, y), (x, z), (y, z)})))
    return out


def _closer():
    """The count inside a task: a nested function, which workers get whole and for which they need no copy of this package."""

    def closed(i: np.ndarray, j: np.ndarray, role: np.ndarray) -> int:
        """Wedges i > j > k, of edges (i, j) of role 1 and (j, k) of role 4, that an edge (i, k) of role 2 closes."""
        table = lambda r: (lambda o: (i[r][o], j[r][o]))(np.lexsort((j[r], i[r])))
        (a, b), (u, w), (c, d) = (table(np.flatnonzero(role & r)) for r in (1, 2, 4))
        if not (len(a) and len(u) and len(c)):
            return 0
        least, width = int(d.min()), int(d.max() - d.min()) + 1
        keep = (w >= least) & (w < least + width)
        u, w, d = u[keep], w[keep] - least, d - least
        lo, hi = np.searchsorted(c, b), np.searchsorted(c, b, "right")
        size, found = hi - lo, 0
        a, lo, size = a[size > 0], lo[size > 0], size[size > 0]
        tops, at = np.unique(a, return_inverse=True)
        rows = max(1, (32 << 20) // width)
        sums = np.concatenate([[0], np.cumsum(size)])
        start = 0
        marks = np.zeros(rows * width, bool)
        while start < len(a):
            first = at[start]
            stop = min(np.searchsorted(at, first + rows), max(start + 1, np.searchsorted(sums, sums[start] + (4 << 20), "right") - 1))
            last = at[stop - 1]
            s, t = np.searchsorted(u, tops[first]), np.searchsorted(u, tops[last], "right")
            near = np.searchsorted(tops, u[s:t])
            known = tops[near] == u[s:t]
            cells = (near[known] - first) * width + w[s:t][known]
            marks[cells] = True
            n = size[start:stop]
            places = np.repeat(lo[start:stop] - (sums[start:stop] - sums[start]), n) + np.arange(sums[stop] - sums[start])
            found += int(np.count_nonzero(marks[np.repeat((at[start:stop] - first) * width, n) + d[places]]))
            marks[cells] = False
            start = int(stop)
        return found

    return closed


def triangle_total(low: Matrix):
    """(v): the triangles of an undirected graph without loops, given by its entries with i > j.

    The masked product low @ low.T by blocks: vertices fall into ranges, and a task holds the edges
    between three of them, so wedges are made and closed inside the task and never exchanged. There are
    as many ranges as let a task hold TASK_EDGES edges, and triples that no edges join are left out;
    an edge goes to at most as many tasks as there are ranges.
    """
    spark = low.df.sparkSession
    step = -(-(low.df.agg(F.max("i")).first()[0] or 0) // FINE) + 1
    e = low.df.select("i", "j")
    fine = np.zeros((FINE, FINE))
    for x, y, n in e.groupBy(F.floor(F.col("i") / step), F.floor(F.col("j") / step)).count().toLocalIterator():
        fine[x, y] = n
    p = 1
    while True:
        own, c = _blocks(fine, p)
        triples = _triples(c)
        if p >= MOST or all(n <= TASK_EDGES for *_, n in triples):
            break
        p += max(1, p // 4)
    to = {}
    for t, (z, y, x, _) in enumerate(triples):
        for pair, role in (((x, y), 1), ((x, z), 2), ((y, z), 4)):
            tasks = to.setdefault(pair, {})
            tasks[t] = tasks.get(t, 0) | role
    n = max(1, len(triples))
    slot = {}  # numbers that hash into partitions of their own, so that no task holds two triples
    for k, at in spark.range(20 * n + 200).select(F.col("id"), F.pmod(F.hash(F.col("id").cast("int")), F.lit(n))).collect():
        slot.setdefault(at, k)
    name = sorted(slot.values()) + [-k for k in range(1, 1 + n - len(slot))]
    rows = [(x * p + y, name[t], role) for (x, y), tasks in to.items() for t, role in tasks.items()]
    routes = spark.createDataFrame(rows, "pair long, t int, role int") if rows else spark.createDataFrame([], "pair long, t int, role int")
    range_of = F.array(*(F.lit(int(k)) for k in own))
    block = lambda k: F.element_at(range_of, (F.floor(F.col(k) / step) + 1).cast("int"))
    sent = e.withColumn("pair", block("i").cast("long") * p + block("j")).join(F.broadcast(routes), "pair").select("t", "i", "j", "role")

    closed = _closer()

    def count(table):
        i, j, role = (table.column(k).to_numpy() for k in ("i", "j", "role"))
        return pa.table({"v": pa.array([closed(i, j, role)], pa.int64())})

    counts = spread(sent, n, "t").groupBy("t").applyInArrow(count, "v long")
    return counts.agg(F.coalesce(F.sum("v"), F.lit(0)).cast("long").alias("v"))


def triangles(a: Matrix) -> int:
    """Triangles of an undirected graph."""
    return triangle_total(a.select("tril", -1).new()).first()[0]


def modularity(a: Matrix, community: Vector) -> float:
    """Sum over the communities of the share of weight inside less the squared share of degrees."""
    return _modularity(a.df.groupBy("i", "j").agg(F.sum(F.col("v").cast("double")).alias("v")), community.df.select("i", F.col("v").alias("c")))


def _modularity(g, c) -> float:
    inside = g.join(c, "i").join(c.select(F.col("i").alias("j"), F.col("c").alias("e")), "j")
    parts = inside.groupBy("c").agg(F.sum("v").alias("vol"), F.sum(F.when(F.col("c") == F.col("e"), F.col("v")).otherwise(0.0)).alias("in"))
    total, within, squares = parts.agg(F.sum("vol"), F.sum("in"), F.sum(F.col("vol") * F.col("vol"))).first()
    return within / total - squares / (total * total) if total else 0.0


def _moves(g, deg, c, total: float):
    """(i, own, to, gain) of all moves to a neighbouring community that raise modularity; gain is half the rise."""
    volume = deg.join(c, "i").groupBy("c").agg(F.sum("d").alias("vol"))
    near = g.where("i <> j").join(c.select(F.col("i").alias("j"), "c"), "j").groupBy("i", "c").agg(F.sum("v").alias("k"))
    own = c.select("i", F.col("c").alias("own"))
    stay = own.join(near.withColumnRenamed("c", "own"), ["i", "own"], "left").select("i", "own", F.coalesce("k", F.lit(0.0)).alias("k0"))
    x = near.join(deg, "i").join(volume, "c").join(stay, "i").join(volume.select(F.col("c").alias("own"), F.col("vol").alias("vol0")), "own")
    gain = (F.col("k") - F.col("k0")) / total - F.col("d") * (F.col("vol") - F.col("vol0") + F.col("d")) / (total * total)
    return x.where("c <> own").select("i", "own", F.col("c").alias("to"), gain.alias("gain")).where("gain > 1e-12")


def _best(moves):
    """Each vertex's move of largest gain, of equal ones to the smallest label."""
    m = moves.groupBy("i", "own").agg(F.max(F.struct("gain", (-F.col("to")).alias("to"))).alias("m"))
    return m.select("i", "own", (-F.col("m.to")).alias("to"), F.col("m.gain").alias("gain"))


def _apart(best):
    """Moves of which no two touch a community in common, so that their gains add up; the largest gain is among them."""
    key = F.struct("gain", (-F.col("i")).alias("i"))
    ends = best.select("i", "gain", F.explode(F.array("own", "to")).alias("c"))
    first = ends.groupBy("c").agg(F.max(key).alias("m")).select((-F.col("m.i")).alias("i"))
    return best.join(first.groupBy("i").count().where("count = 2").select("i"), "i")


def _settle(g, shape: tuple, max_passes: int | None):
    """(i, c) of a graph's vertices when no single move raises modularity any more.

    A pass moves every vertex at once, by turns to smaller and to larger labels, so that two cannot swap. Together such
    moves may lower modularity; then only those that do not touch each other are made, which raise it by their sum.
    """
    deg = g.groupBy("i").agg(F.sum("v").alias("d")).persist()
    total = deg.agg(F.sum("d")).first()[0] or 1.0
    c = Vector.of(deg.select("i", F.col("i").alias("v")), INT64, shape).checkpoint().df.toDF("i", "c")
    q, turn = _modularity(g, c), 0

    def moved(some):
        new = c.join(some.select("i", "to"), "i", "left").select("i", F.coalesce("to", "c").alias("v"))
        new = Vector.of(new, INT64, shape).checkpoint().df.toDF("i", "c")
        return new, _modularity(g, new)

    while max_passes is None or turn < max_passes:
        moves = _moves(g, deg, c, total).persist()
        if not moves.head(1):
            break
        new, r = moved(_best(moves.where("to > own" if turn % 2 else "to < own")))
        if r <= q + 1e-12:
            new, r = moved(_apart(_best(moves)))
        moves.unpersist()
        if r <= q:
            break  # a rise too small for a DOUBLE
        c, q, turn = new, r, turn + 1
    deg.unpersist()
    least = c.groupBy("c").agg(F.min("i").alias("least"))
    return Vector.of(c.join(least, "c").select("i", F.col("least").alias("v")), INT64, shape).checkpoint().df.toDF("i", "c")


def louvain_levels(a: Matrix, max_passes: int | None = None) -> list[Vector]:
    """Each level's communities of the vertices of an undirected weighted graph, by their smallest vertices.

    The communities of a level are the vertices of the next, with the weights between and inside them added up, until
    a level joins none. max_passes bounds a level's passes; by default each goes on until nothing moves.
    """
    g = a.df.groupBy("i", "j").agg(F.sum(F.col("v").cast("double")).alias("v"))
    found = Vector.of(Vector.of(None, INT64, (a.nrows,)).dense_coords().withColumn("v", F.col("i")), INT64, (a.nrows,))
    out = []
    while True:
        g = Matrix.of(g, FP64, a.shape).checkpoint().df
        c = _settle(g, found.shape, max_passes)
        if not c.where("i <> c").head(1):
            return out or [found]
        df = found.df.join(c.toDF("v", "c"), "v", "left").select("i", F.coalesce("c", "v").alias("v"))
        found = Vector.of(df, INT64, found.shape).checkpoint()
        out.append(found)
        g = g.join(c, "i").join(c.toDF("j", "e"), "j").groupBy("c", "e").agg(F.sum("v").alias("v")).toDF("i", "j", "v")


def louvain(a: Matrix, max_passes: int | None = None) -> Vector:
    """Communities of an undirected weighted graph: the last of louvain_levels."""
    return louvain_levels(a, max_passes)[-1]
