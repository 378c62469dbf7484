"""Components against union and find."""

import random

from pairloom.operators import components
from pairloom.plans import catalogue

SF = "/root/testdata/sf0.01"


def collected(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def brute_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            root[b] = a
    return {x: find(x) for x in list(root)}


def test_components_of_sparse_graphs(spark):
    rng = random.Random(2)
    for n, m in ((200, 60), (200, 110), (60, 200)):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        got = dict(collected(components.connected_components(spark.createDataFrame(edges, "u int, v int")), "node", "component"))
        assert got == brute_components(edges)


def test_connected_components_use_all_edges(spark):
    got = dict(collected(catalogue.connected_components(spark, SF), "node", "component"))
    assert got == brute_components(collected(catalogue.edges(spark, SF), "u", "v"))
