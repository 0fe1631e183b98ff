"""Louvain against brute force over all partitions of small graphs."""

import itertools
import random

import pytest

from lattica import Matrix
from lattica.plans import graph


def score(edges, label):
    total = sum(edges.values())
    deg = {}
    for (i, _), w in edges.items():
        deg[label[i]] = deg.get(label[i], 0) + w
    return sum(w for (i, j), w in edges.items() if label[i] == label[j]) / total - sum(d * d for d in deg.values()) / total**2


def partitions(n):
    def grow(label):
        if len(label) == n:
            yield label
        else:
            for c in range(max(label, default=-1) + 2):
                yield from grow([*label, c])

    return grow([])


def both(pairs):
    return {e: w for i, j, w in pairs for e in ((i, j), (j, i))}


def run(edges, n):
    a = Matrix.from_coo([i for i, _ in edges], [j for _, j in edges], list(edges.values()), nrows=n, ncols=n)
    levels = [v.to_dict() for v in graph.louvain_levels(a)]
    for label in levels:
        assert len(label) == n and all(label[c] == c <= i for i, c in label.items())
    q = [score(edges, label) for label in levels]
    assert q == sorted(q) and graph.modularity(a, graph.louvain(a)) == pytest.approx(q[-1])
    label = levels[-1]
    for c, e in itertools.combinations(sorted(set(label.values())), 2):  # no two communities are better as one
        assert score(edges, {i: c if x == e else x for i, x in label.items()}) <= q[-1] + 1e-9
    return levels


def test_reference_example(spark):
    cliques = [*itertools.combinations((0, 1, 3, 4), 2), *itertools.combinations((2, 5, 6), 2), (2, 4)]
    edges = both((i, j, 1) for i, j in cliques)
    label = run(edges, 7)[-1]
    assert label == {0: 0, 1: 0, 3: 0, 4: 0, 2: 2, 5: 2, 6: 2}
    assert score(edges, label) == pytest.approx(max(score(edges, p) for p in partitions(7)))


def test_best_move_to_a_larger_label(spark):
    # 0 is drawn to 3 and 4, of larger labels, and 1 to 2
    edges = both([(0, 3, 5), (0, 4, 5), (3, 4, 1), (1, 2, 4), (0, 1, 1)])
    label = run(edges, 6)[-1]
    assert label == {0: 0, 3: 0, 4: 0, 1: 1, 2: 1, 5: 5}


def test_levels_of_a_ring_of_cliques(spark):
    pairs = [(4 * k + i, 4 * k + j, 1) for k in range(16) for i, j in itertools.combinations(range(4), 2)]
    pairs += [(4 * k, (4 * k + 5) % 64, 1) for k in range(16)]
    r = random.Random(4)
    new = r.sample(range(64), 64)
    edges = both((new[i], new[j], w) for i, j, w in pairs)
    levels = run(edges, 64)
    assert len(levels) > 1
    assert score(edges, levels[-1]) > score(edges, {new[i]: i // 4 for i in range(64)}) - 0.02


def test_no_edges(spark):
    assert run({(1, 1): 2}, 3) == [{0: 0, 1: 1, 2: 2}]
