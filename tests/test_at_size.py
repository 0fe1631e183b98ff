"""What keeps a task's share of large inputs small: explicit exchanges, blocks, lists; each against brute force."""

import itertools
import random

import pytest
from pyspark.sql import DataFrame

import __spark_entry__ as entry
from lattica import Matrix, Vector
from lattica.operators import collection
from lattica.plans import graph

SF = "/root/testdata/sf0.001"


def edges(n, m, seed):
    r = random.Random(seed)
    return {(max(e), min(e)) for e in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if e[0] != e[1]}


def matrix(pairs, n):
    return Matrix.from_coo([i for i, _ in pairs], [j for _, j in pairs], [1] * len(pairs), nrows=n, ncols=n)


@pytest.fixture
def small(monkeypatch):
    """Inputs of a KB count as large."""
    monkeypatch.setattr(collection, "PIECE", 1 << 10)
    monkeypatch.setattr(collection, "FEW", 0)


@pytest.fixture
def uncached(monkeypatch):
    def persist(*a):
        raise AssertionError("a graph of the input's size is kept in memory")

    monkeypatch.setattr(DataFrame, "persist", persist)


def test_triangles_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "TASK_EDGES", 300)
    low = edges(60, 700, 1) | {(5000 + i, 5000 + j) for i, j in edges(40, 300, 2)}
    want = sum((a, b) in low and (b, c) in low and (a, c) in low for a, b, c in itertools.chain(*(itertools.combinations(range(top, bottom, -1), 3) for top, bottom in ((60, -1), (5040, 4999)))))
    assert graph.triangle_total(matrix(sorted(low), 1 << 20)).collect() == [(want,)]
    assert graph.triangle_total(matrix([(3, 1)], 8)).collect() == [(0,)]
    assert graph.triangle_total(Matrix("INT64", 8, 8)).collect() == [(0,)]


def test_outer_of_one_file_takes_many_tasks(spark):
    v = Vector.of(spark.range(50).coalesce(1).selectExpr("id AS i", "id * 3 AS v"), "INT64", (50,))
    got = v.outer(v, "minus").new().df
    assert got.rdd.getNumPartitions() > 1
    assert {(r.i, r.j): r.v for r in got.collect()} == {(i, j): 3 * (i - j) for i in range(50) for j in range(50)}


def test_overlaps(spark, small):
    r = random.Random(3)
    cells = sorted({(r.randrange(40), r.randrange(60)) for _ in range(200)})
    got = graph.overlaps(matrix(cells, 64)).to_dict()
    assert got == {i: len({k for k, c in cells if (i, c) in cells}) for i in {i for i, _ in cells}}


def test_components(spark, uncached):
    pairs = sorted(edges(90, 60, 4)) + [(200 + k, 201 + k) for k in range(40)] + [(300, 300)]
    label = {x: x for e in pairs for x in e}
    for _ in label:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    a = matrix(pairs, 320)
    assert graph.connected_components(a, isolated=False).to_dict() == label
    assert graph.connected_components(a).to_dict() == {i: label.get(i, i) for i in range(320)}


def test_pagerank_with_sinks(spark, uncached):
    pairs, n = [(0, 1), (0, 2), (1, 2), (3, 0)], 4
    r = [1 / n] * n
    for _ in range(3):
        sinks = sum(r[i] for i in range(n) if i not in {a for a, _ in pairs})
        r = [0.15 / n + 0.85 * (sinks / n + sum(r[a] / sum(x == a for x, _ in pairs) for a, b in pairs if b == j)) for j in range(n)]
    assert graph.pagerank(matrix(pairs, n), iterations=3).to_dict() == pytest.approx(dict(enumerate(r)))


@pytest.mark.parametrize("name", ["bfs_parents", "sssp", "bfs_levels"])
def test_searches_keep_nothing_in_memory(spark, uncached, name):
    a = matrix([(0, 1), (1, 2), (0, 3), (3, 2), (2, 4)], 6)
    want = {"bfs_levels": {0: 1, 1: 2, 3: 2, 2: 3, 4: 4}, "bfs_parents": {0: 0, 1: 0, 3: 0, 2: 1, 4: 2}, "sssp": {0: 0.0, 1: 1.0, 3: 1.0, 2: 2.0, 4: 3.0}}
    assert getattr(graph, name)(a, 0).to_dict() == want[name]


@pytest.mark.parametrize("name", ["mxm_band_band", "mxm_lor_eq", "mxm_max_plus", "udt_pair", "cosupply"])
def test_partitions_follow_the_input(spark, monkeypatch, name):
    plain = sorted(map(tuple, entry.queries()[name](spark, SF).collect()))
    monkeypatch.setattr(collection, "PIECE", 8 << 10)
    monkeypatch.setattr(collection, "FEW", 0)
    df = entry.queries()[name](spark, SF)
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect())) == plain
