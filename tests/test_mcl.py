"""Markov clustering: tiled products and iteration by components against plain matrices."""

import random

import numpy as np
import pytest

from pairloom.operators import clustering


def graph(seed, groups=3, size=9):
    """Components of dense, joined modules, single pairs, and a node with nothing but a loop."""
    rng = random.Random(seed)
    edges = []
    for g in range(groups):
        edges += [(100 * g + a, 100 * g + b, float(rng.randint(1, 9))) for a in range(size) for b in range(a, size) if b == a + 1 or rng.random() < (0.6 if a // 4 == b // 4 else 0.1)]
    return [*edges, (900, 901, 2.0), (902, 903, 1e-3), (950, 950, 4.0)]


def plain_start(edges):
    nodes = sorted({x for u, v, _ in edges for x in (u, v)})
    at = {n: k for k, n in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for u, v, w in edges:
        if u != v:
            m[at[u], at[v]] = m[at[v], at[u]] = w
    for k in range(len(nodes)):
        m[k, k] = m[:, k].max() or 1.0
    return nodes, m / m.sum(axis=0)


def plain_step(m, inflation, prune):
    m = m @ m
    m = np.where(m < prune, 0, m) ** inflation
    return m / m.sum(axis=0)


def cells(nodes, m):
    return {(nodes[i], nodes[j]): pytest.approx(m[i, j], rel=1e-9) for i, j in zip(*np.nonzero(m), strict=True)}


@pytest.mark.parametrize(("tile", "cost", "strip"), [(1024, 100, 1_000_000), (4, 100, 1_000_000), (4, 0, 7), (4, 10**9, 1_000_000)])
@pytest.mark.parametrize("prune", [0.0, 0.02])
def test_step_equals_plain_product(spark, monkeypatch, tile, cost, strip, prune):
    monkeypatch.setattr(clustering, "TILE", tile)
    monkeypatch.setattr(clustering, "PAIR_COST", cost)
    monkeypatch.setattr(clustering, "STRIP", strip)
    edges = graph(tile)
    nodes, m = plain_start(edges)
    start = clustering.mcl_start(spark.createDataFrame(edges, "u int, v int, weight double"))
    found = {(r["i"], r["j"]): r["w"] for r in clustering.mcl_step(start, 1.2, prune).collect()}
    assert found == cells(nodes, plain_step(m, 1.2, prune))


def test_cells_whose_products_vanish_stay(spark):
    rows = [(0, 0, 1e-200), (0, 1, 1.0), (1, 0, 1e-200)]
    m = spark.createDataFrame(rows, "i int, j int, w double")
    tiles = clustering.mcl_tiles(m)
    found = {(r["i"], r["j"]): r["w"] for r in clustering.squared(m, tiles).collect()}
    assert found == {(0, 0): 1e-200, (0, 1): 1e-200, (1, 0): 0.0, (1, 1): 1e-200}


def test_partial_sums_are_not_shuffled(spark):
    """n nodes with all edges: an operator below the product deals out cells, not the n cubed pairs or the partial sums of each task."""
    n = 60
    start = clustering.materialise(clustering.mcl_start(spark.createDataFrame([(a, b, 1.0) for a in range(n) for b in range(a, n)], "u int, v int, weight double")))
    tiles = clustering.mcl_tiles(start)
    dealt = []
    task = clustering._multiplied(0.0)
    rows = start.join(tiles.selectExpr("node AS i", "tile AS ti", "at AS r"), "i").join(tiles.selectExpr("node AS j", "tile AS tj", "at AS c"), "j")
    for side, tk, node in ((0, "tj", "i"), (1, "ti", "j")):
        dealt.append(rows.selectExpr("ti", "tj", f"{tk} AS tk", f"{side} AS side", "r", "c", f"{node} AS node", "w"))
    out = [*task(dealt[0].union(dealt[1]).orderBy("ti", "tj", "tk", "side").toArrow().to_batches())]
    assert sum(b.num_rows for b in out) == n * n and dealt[0].count() + dealt[1].count() == 2 * n * n


@pytest.mark.parametrize("seed", [1, 2])
def test_components_in_memory_equal_the_whole_by_tiles(spark, monkeypatch, seed):
    df = spark.createDataFrame(graph(seed), "u int, v int, weight double")
    here = {r["node"]: r["cl"] for r in clustering.mcl(df, inflation=1.6).collect()}
    monkeypatch.setattr(clustering, "LOCAL_NODES", 0)
    monkeypatch.setattr(clustering, "TILE", 5)
    there = {r["node"]: r["cl"] for r in clustering.mcl(df, inflation=1.6).collect()}
    assert here == there and len(here) == 32


@pytest.mark.parametrize("local", [2048, 4, 0])
def test_two_steps_equal_plain_products(spark, monkeypatch, local):
    """Small components whole in a task, larger ones by tiles; no step of a small one is written."""
    monkeypatch.setattr(clustering, "LOCAL_NODES", local)
    monkeypatch.setattr(clustering, "STRIP", 30)
    stepped = []
    step = clustering.mcl_step
    monkeypatch.setattr(clustering, "mcl_step", lambda *a, **b: stepped.append(1) or step(*a, **b))
    edges = graph(7)
    nodes, m = plain_start(edges)
    start = clustering.mcl_start(spark.createDataFrame(edges, "u int, v int, weight double"))
    found = {(r["i"], r["j"]): r["w"] for r in clustering.mcl_iterated(start, 2).collect()}
    assert found == cells(nodes, plain_step(plain_step(m, 1.2, 0.0), 1.2, 0.0))
    assert len(stepped) == (0 if local == 2048 else 2)


def test_vanishing_cells_of_a_small_component_stay(spark):
    rows = [(0, 0, 1e-200), (0, 1, 1.0), (1, 0, 1e-200), (1, 1, 0.5)]
    found = {(r["i"], r["j"]) for r in clustering.mcl_iterated(spark.createDataFrame(rows[:3], "i int, j int, w double"), 1).collect()}
    assert found == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_components_beyond_local_ones_are_settled_in_a_task(spark, monkeypatch):
    """Components of up to three times ``LOCAL_NODES`` need no step by tiles, and get the clusters that they get by tiles."""
    df = spark.createDataFrame(graph(3, groups=2), "u int, v int, weight double")
    monkeypatch.setattr(clustering, "LOCAL_NODES", 4)
    monkeypatch.setattr(clustering, "ROWS", 5, raising=False)
    monkeypatch.setattr(clustering, "mcl_step", lambda *a, **b: pytest.fail("a step by tiles"))
    found = {r["node"]: r["cl"] for r in clustering.mcl(df, inflation=1.6).collect()}
    assert len(found) == 23
    monkeypatch.setattr(clustering, "LOCAL_NODES", 2048)
    assert found == {r["node"]: r["cl"] for r in clustering.mcl(df, inflation=1.6).collect()}
