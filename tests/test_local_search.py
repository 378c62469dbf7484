"""Smart local moving: planted modules, never worse than it started, better than plain levels where these merge too early."""

import random

import pytest

from pairloom.operators import clustering, local_search
from pairloom.operators.local_search import search, smart_search


def modularity(edges, label, r):
    whole = 2 * sum(w for _, _, w in edges)
    inside, total = {}, {}
    for u, v, w in edges:
        for x in (u, v):
            total[label[x]] = total.get(label[x], 0) + w
        if label[u] == label[v]:
            inside[label[u]] = inside.get(label[u], 0) + 2 * w
    return sum(inside.get(c, 0) / whole - r * (t / whole) ** 2 for c, t in total.items())


def planted(rng, groups, size, inner, outer):
    n = groups * size
    return [(a, b, 1.0) for a in range(n) for b in range(a + 1, n) if rng.random() < (inner if a // size == b // size else outer)] + [(a, a, 0.5) for a in range(0, n, 7)]


@pytest.mark.parametrize("resolution", [1.0, 2.0])
def test_smart_moves_are_no_worse(resolution):
    rng = random.Random(3)
    better = 0.0
    for k in range(12):
        edges = planted(rng, 8, 10, 0.5, 0.08)
        nodes = sorted({x for u, v, _ in edges for x in (u, v)})
        whole = 2 * sum(w for _, _, w in edges)
        plain = modularity(edges, search(nodes, edges, whole, "modularity", k, resolution), resolution)
        smart = modularity(edges, smart_search(nodes, edges, whole, k, resolution), resolution)
        assert smart > plain - 0.02
        better += smart - plain
    assert better > 0


def test_planted_modules(spark):
    edges = planted(random.Random(5), 6, 12, 0.8, 0.02)
    df = spark.createDataFrame(edges, "u int, v int, weight double")
    found = {r["node"]: r["cl"] for r in clustering.smart_local_moving(df).collect()}
    assert [found[k] for k in range(72)] == [k // 12 for k in range(72)]


@pytest.mark.parametrize("resolution", [1.0, 2.0])
def test_moves_by_arrays_equal_single_ones(monkeypatch, resolution):
    for k in range(4):
        edges = [(a, b, w * random.Random(a * 99 + b).random() + 0.1) for a, b, w in planted(random.Random(k), 5, 16, 0.7, 0.15)]
        nodes = sorted({x for u, v, _ in edges for x in (u, v)})
        whole = 2 * sum(w for _, _, w in edges)
        found = []
        for least in (1, 10**9):
            monkeypatch.setattr(local_search, "ARRAY_LINKS", least)
            found.append(smart_search(nodes, edges, whole, k, resolution))
        assert found[0] == found[1]


@pytest.mark.parametrize("smart", [True, False])
def test_starts_side_by_side_equal_those_in_a_row(spark, monkeypatch, smart):
    edges = [(a + 200 * k, b + 200 * k, w) for k in range(2) for a, b, w in planted(random.Random(k), 4, 9, 0.5, 0.2)]
    df = spark.createDataFrame(edges, "u int, v int, weight double")
    found = []
    for least in (10**9, 1):
        monkeypatch.setattr(clustering, "SPLIT_EDGES", least)
        found.append({r["node"]: r["cl"] for r in clustering.louvain(df, 3, 1.0, 5, smart).collect()})
    assert found[0] == found[1]
