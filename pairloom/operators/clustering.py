"""Communities of the contact graph, as (node, cl)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators import graph as g
from pairloom.operators.components import connected_components
from pairloom.operators.local_search import search, smart_search
from pairloom.session import materialise, release

METHODS = ("infomap", "louvain", "mcl", "slm", "simap")
#: Edges of a component from which each start is a task of its own, and partitions of the searches at most (each may hold several).
SPLIT_EDGES, MOST_PARTS = 2_000, 2_000
#: Nodes of a tile of a matrix (small components may fill up to twice as many), nodes of a component that Markov clustering iterates in memory, cells of
#: a product that are worked out at once by pairs, the cost of such a pair in steps of a dense product, and rows up to which pairs of tiles are broadcast.
TILE, LOCAL_NODES, STRIP, PAIR_COST, BROADCAST_ROWS = 1024, 2048, 1_000_000, 100, 300_000
#: Times ``LOCAL_NODES`` nodes up to which Markov clustering iterates a component in one task at all (two matrices of 8 bytes a cell and a part of one:
#: about 0.8 GB), rows of a matrix that are worked out at once, and threads that do so.
WHOLE, ROWS, THREADS = 3, 256, 2
#: Flow from which a settled matrix ties two nodes.
FLOW = 1e-3


def _numbered(parts: DataFrame) -> DataFrame:
    """(node, cl) from (node, part, sub): numbers by the smallest member."""
    head = parts.groupBy("part", "sub").agg(F.min("node").alias("head"))
    number = head.select("part", "sub", (F.row_number().over(Window.orderBy("head")) - 1).alias("cl"))
    return parts.join(number, ["part", "sub"]).select("node", F.col("cl").cast("int").alias("cl"))


def louvain(edges: DataFrame, seed: int = 1, resolution: float = 1.0, starts: int = 1, smart: bool = False) -> DataFrame:
    """Communities of high modularity, by Louvain's levels or by smart local moving.

    Given the whole graph's weight, modularity is a sum over components, so each component is searched by itself; that is exact.  A component must fit
    a task's memory.  With several starts the best is kept for each component (ties: the first); those of a large component run side by side.
    """
    edges = materialise(edges)
    whole = 2.0 * (edges.agg(F.sum("weight")).first()[0] or 1.0)
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    labels = nodes.join(connected_components(edges), "node", "left").select("node", F.coalesce("component", "node").alias("part"))
    rows = edges.join(labels.withColumnRenamed("node", "u"), "u").select("part", "u", "v", "weight")
    sizes = materialise(rows.groupBy("part").agg((F.count("*") >= SPLIT_EDGES).alias("large")))
    runs = F.when(F.col("large"), F.sequence(F.lit(0), F.lit(starts - 1))).otherwise(F.array(F.lit(-1)))
    dealt = rows.join(sizes, "part").select("part", F.explode(runs).alias("run"), "u", "v", "weight")
    kind = dict(edges.dtypes)["u"]

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        """The best of the starts of a small component, or one start of a large one."""
        triples = [*pdf[["u", "v", "weight"]].sort_values(["u", "v"]).itertuples(index=False, name=None)]
        own = sorted({x for u, v, _ in triples for x in (u, v)})
        run = int(pdf["run"].iloc[0])
        best, most = None, float("-inf")
        for k in range(starts) if run < 0 else (run,):
            found = smart_search(own, triples, whole, seed + k, resolution) if smart else search(own, triples, whole, "modularity", seed + k, resolution)
            inside: dict[int, float] = {}
            total: dict[int, float] = {}
            for u, v, w in triples:
                total[found[u]] = total.get(found[u], 0.0) + w / whole
                total[found[v]] = total.get(found[v], 0.0) + w / whole
                if found[u] == found[v]:
                    inside[found[u]] = inside.get(found[u], 0.0) + 2 * w / whole
            q = sum(inside.get(c, 0.0) - resolution * t * t for c, t in total.items())
            if q > most + 1e-12:
                best, most = found, q
        return pd.DataFrame({"part": pdf["part"].iloc[0], "run": run, "q": most, "node": own, "sub": [best[n] for n in own]})

    # as many partitions as there are searches to share out: by their bytes, Spark would put them all into one task
    parts = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, 2 * starts * sizes.where("large").count()))
    found = materialise(dealt.repartition(parts, "part", "run").groupBy("part", "run").applyInPandas(task, f"part {kind}, run int, q double, node {kind}, sub int"))
    tried = found.select("part", "run", "q").distinct().groupBy("part").agg(F.sort_array(F.collect_list(F.struct("run", "q"))).alias("tried"))
    better = F.aggregate("tried", F.col("tried")[0], lambda best, x: F.when(x["q"] > best["q"] + 1e-12, x).otherwise(best))
    chosen = tried.select("part", better["run"].alias("run"))
    release(sizes)
    return _numbered(found.join(chosen, ["part", "run"]).select("node", "part", "sub"))


def smart_local_moving(edges: DataFrame, seed: int = 1, starts: int = 10) -> DataFrame:
    """Smart local moving at resolution 2: the best of ten starts of up to ten iterations each."""
    return louvain(edges, seed, resolution=2.0, starts=starts, smart=True)


def map_equation(edges: DataFrame, seed: int = 1, trials: int = 10) -> DataFrame:
    """Communities of short two-level codelength: seeded trials side by side, the shortest kept (ties: the first).

    The exit term couples all communities, so a trial sees the whole graph and a task holds it; trials run in parallel.
    """
    flow = materialise(edges.where("u <> v"))
    whole = 2.0 * (flow.agg(F.sum("weight")).first()[0] or 1.0)
    kind = dict(edges.dtypes)["u"]
    rows = flow.select(F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial"), "u", "v", "weight")

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        triples = [*pdf[["u", "v", "weight"]].sort_values(["u", "v"]).itertuples(index=False, name=None)]
        own = sorted({x for u, v, _ in triples for x in (u, v)})
        trial = int(pdf["trial"].iloc[0])
        found = search(own, triples, whole, "map", seed + trial)
        return pd.DataFrame({"trial": trial, "node": own, "cl": [found[n] for n in own]})

    all_trials = materialise(rows.groupBy("trial").applyInPandas(task, f"trial int, node {kind}, cl int"))
    best, least = 0, None
    for trial in range(trials):
        bits = g.codelength(flow, all_trials.where(F.col("trial") == trial).select("node", "cl")).first()
        if bits is not None and bits[0] is not None and (least is None or bits[0] < least - 1e-12):
            best, least = trial, bits[0]
    return _numbered(all_trials.where(F.col("trial") == best).select("node", F.lit(0).alias("part"), F.col("cl").alias("sub")))


def stochastic(matrix: DataFrame) -> DataFrame:
    """Columns (j) that sum to 1."""
    sums = matrix.groupBy("j").agg(F.sum("w").alias("s"))
    return matrix.join(sums, "j").select("i", "j", (F.col("w") / F.col("s")).alias("w"))


def mcl_start(edges: DataFrame) -> DataFrame:
    """The graph as a column-stochastic matrix; each node has a loop as heavy as its heaviest edge."""
    both = g.both_ways(edges.where("u <> v")).select(F.col("u").alias("i"), F.col("v").alias("j"), F.col("weight").alias("w"))
    loops = both.groupBy("j").agg(F.max("w").alias("w")).select(F.col("j").alias("i"), "j", "w")
    alone = edges.where("u = v").select(F.col("u").alias("i"), F.col("v").alias("j"), F.lit(1.0).alias("w")).join(loops.select("i"), "i", "left_anti")
    return stochastic(both.unionByName(loops).unionByName(alone.select("i", "j", "w")))


def mcl_tiles(matrix: DataFrame) -> DataFrame:
    """(node, component, n, tile, at): nodes dealt to tiles of about ``TILE``, and numbered within their tile.

    No cell of a power of the matrix lies between components, so small ones share a tile whole, and only those beyond a tile are cut (by hash).  What is
    numbered in one ordered pass has a row per component.
    """
    nodes = matrix.select(F.col("i").alias("node")).union(matrix.select("j")).distinct()
    labels = nodes.join(connected_components(matrix, "i", "j"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    labels = materialise(labels)
    before = Window.orderBy("component").rowsBetween(Window.unboundedPreceding, -1)
    small, pieces = F.col("n") <= TILE, F.ceil(F.col("n") / TILE)
    sizes = labels.groupBy("component").agg(F.count("*").alias("n")).select(
        "component", "n", pieces.alias("pieces"),
        F.coalesce(F.sum(F.when(small, F.col("n")).otherwise(0)).over(before), F.lit(0)).alias("small_before"),
        F.coalesce(F.sum(F.when(small, 0).otherwise(pieces)).over(before), F.lit(0)).alias("pieces_before"),
    )
    tile = F.when(small, -1 - F.floor(F.col("small_before") / TILE)).otherwise(F.col("pieces_before") + F.pmod(F.xxhash64("node"), F.col("pieces")))
    dealt = labels.join(sizes, "component").select("node", "component", "n", tile.cast("bigint").alias("tile"))
    out = materialise(dealt.withColumn("at", F.row_number().over(Window.partitionBy("tile").orderBy("node")) - 1))
    release(labels)
    return out


def _grown(x: np.ndarray, *shape: int) -> np.ndarray:
    """The array with at least so many places; new ones are 0."""
    if all(n >= k for n, k in zip(x.shape, shape, strict=True)):
        return x
    out = np.zeros([max(n, k) for n, k in zip(x.shape, shape, strict=True)], x.dtype)
    out[tuple(slice(n) for n in x.shape)] = x
    return out


class _Tile:
    """Cells of one tile of a product: their sums, which of them any path leads to, and the nodes of its rows and columns."""

    def __init__(self) -> None:
        self.sums, self.met, self.nodes = np.zeros((0, 0)), np.zeros((0, 0), bool), [None, None]

    def add(self, left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...]) -> None:
        """Adds the product of two tiles (row, column, node, w)."""
        (r, ka, own, x), (kb, c, other, y) = left, right
        self.sums, self.met = (_grown(z, r.max() + 1, c.max() + 1) for z in (self.sums, self.met))
        for k, (at, node) in enumerate(((r, own), (c, other))):
            self.nodes[k] = _grown(np.zeros(0, node.dtype) if self.nodes[k] is None else self.nodes[k], at.max() + 1)
            self.nodes[k][at] = node
        n = max(ka.max(), kb.max()) + 1
        rows, columns, in_a, in_b = np.unique(r), np.unique(c), np.bincount(ka, minlength=n), np.bincount(kb, minlength=n)
        met = np.nonzero(in_a * in_b)[0]
        if PAIR_COST * int((in_a * in_b).sum()) < len(rows) * len(columns) * len(met):
            self._add_pairs(r, ka, x, kb, c, y)
            return
        place = np.full(n, -1)
        place[met] = np.arange(len(met))
        a, b = np.zeros((len(rows), len(met))), np.zeros((len(met), len(columns)))
        fits, meets = place[ka] >= 0, place[kb] >= 0
        at_a, at_b = (np.searchsorted(rows, r[fits]), place[ka[fits]]), (place[kb[meets]], np.searchsorted(columns, c[meets]))
        a[at_a], b[at_b] = x[fits], y[meets]
        made = a @ b
        if min(x.min(), y.min()) > 1e-145:  # no product is 0
            seen = made > 0
        else:
            shown, heard = np.zeros(a.shape, np.float32), np.zeros(b.shape, np.float32)
            shown[at_a], heard[at_b] = 1, 1
            seen = shown @ heard > 0
        cut = np.ix_(rows, columns)
        self.sums[cut] += made
        self.met[cut] |= seen

    def _add_pairs(self, r: np.ndarray, ka: np.ndarray, x: np.ndarray, kb: np.ndarray, c: np.ndarray, y: np.ndarray) -> None:
        order = np.argsort(kb, kind="stable")
        kb, c, y = kb[order], c[order], y[order]
        first = np.searchsorted(kb, ka)
        times = np.searchsorted(kb, ka, side="right") - first
        ends = np.cumsum(times)
        lo = 0
        while lo < len(ka):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STRIP, side="right")))
            n = times[lo:hi]
            left = np.repeat(np.arange(lo, hi), n)
            right = np.repeat(first[lo:hi] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(len(left))
            cell, own = np.unique(r[left] * self.sums.shape[1] + c[right], return_inverse=True)
            self.sums.reshape(-1)[cell] += np.bincount(own, x[left] * y[right], len(cell))
            self.met.reshape(-1)[cell] = True
            lo = hi

    def rows(self, prune: float, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        r, c = np.nonzero(self.met & (self.sums >= prune) if prune else self.met)
        for lo in range(0, len(r), STRIP):
            x, y = r[lo : lo + STRIP], c[lo : lo + STRIP]
            yield pa.record_batch([pa.array(self.nodes[0][x], kind), pa.array(self.nodes[1][y], kind), pa.array(self.sums[x, y])], ["i", "j", "w"])


def _multiplied(prune: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells of a product from rows (ti, tj, tk, side, r, c, node, w) sorted by tile of the product, tile between, and side."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, made, kind = None, _Tile(), None
        held: tuple[list, list] = ([], [])

        def put() -> None:
            if held[0] and held[1]:
                made.add(*(tuple(np.concatenate(z) for z in zip(*side, strict=True)) for side in held))
            held[0].clear()
            held[1].clear()

        for batch in batches:
            ti, tj, tk, side, r, c, node, w = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            kind = batch.schema.field(6).type
            cuts = np.nonzero((np.diff(ti) != 0) | (np.diff(tj) != 0) | (np.diff(tk) != 0) | (np.diff(side) != 0))[0] + 1
            for lo, hi in pairwise([0, *cuts.tolist(), len(w)]):
                if lo == hi:
                    continue
                now = (ti[lo], tj[lo], tk[lo])
                if now != key:
                    put()
                    if key is not None and now[:2] != key[:2]:
                        yield from made.rows(prune, kind)
                        made = _Tile()
                    key = now
                held[side[lo]].append((r[lo:hi], c[lo:hi], node[lo:hi], w[lo:hi]))
        put()
        if kind is not None:
            yield from made.rows(prune, kind)

    return task


def squared(matrix: DataFrame, tiles: DataFrame, prune: float = 0.0) -> DataFrame:
    """The matrix times itself, tile by tile; written down.  Cells are dealt to the tiles of the product they add to, so partial sums are never shuffled."""
    a = tiles.select(F.col("node").alias("i"), F.col("tile").alias("ti"), F.col("at").alias("r"))
    b = tiles.select(F.col("node").alias("j"), F.col("tile").alias("tj"), F.col("at").alias("c"))
    cells = matrix.join(a, "i").join(b, "j")
    blocks = materialise(cells.select("ti", "tj").distinct())
    hint = F.broadcast if blocks.count() <= BROADCAST_ROWS else (lambda x: x)
    left = cells.withColumnRenamed("tj", "tk").join(hint(blocks.select(F.col("ti").alias("tk"), "tj")), "tk").select("ti", "tj", "tk", F.lit(0).alias("side"), "r", "c", F.col("i").alias("node"), F.col("w").cast("double").alias("w"))
    right = cells.withColumnRenamed("ti", "tk").join(hint(blocks.select("ti", F.col("tj").alias("tk"))), "tk").select("ti", "tj", "tk", F.lit(1).alias("side"), "r", "c", F.col("j").alias("node"), F.col("w").cast("double").alias("w"))
    parts = max(int(matrix.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, blocks.count()))
    kind = dict(matrix.dtypes)["i"]
    jobs = left.unionByName(right).repartition(parts, "ti", "tj").sortWithinPartitions("ti", "tj", "tk", "side")
    out = materialise(jobs.mapInArrow(_multiplied(prune), f"i {kind}, j {kind}, w double"))
    release(blocks)
    return out


def mcl_step(matrix: DataFrame, inflation: float = 1.2, prune: float = 0.0, tiles: DataFrame | None = None) -> DataFrame:
    """Expansion (the matrix times itself), pruning, inflation; written down.  ``tiles`` are those of the matrix or of one that it is a power of."""
    own = mcl_tiles(matrix) if tiles is None else tiles
    made = squared(matrix, own, prune)
    out = materialise(stochastic(made.select("i", "j", F.pow("w", F.lit(inflation)).alias("w"))))
    release(made)
    if tiles is None:
        release(own)
    return out


def _settled(i: np.ndarray, j: np.ndarray, w: np.ndarray, inflation: float, prune: float, max_iter: int, tol: float) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of a component and the smallest node that each one's flow ties it to, with the steps in memory."""
    own, at = np.unique(np.concatenate([i, j]), return_inverse=True)
    n = len(own)
    m, after = np.zeros((n, n)), np.empty((n, n))  # transposed: a column of the matrix is a row
    m[at[len(i) :], at[: len(i)]] = w

    def rows(lo: int) -> float:
        """Works out some rows of ``after``; the largest change."""
        made = after[lo : lo + ROWS]
        np.matmul(m[lo : lo + ROWS] if few is None else m[lo : lo + ROWS, few], inner, out=made)
        made[made < prune] = 0
        np.power(made, inflation, out=made, where=made > 0)
        sums = made.sum(axis=1, keepdims=True)
        made /= np.where(sums > 0, sums, 1)
        return float(np.abs(made - m[lo : lo + ROWS]).max())

    with ThreadPoolExecutor(THREADS if n > LOCAL_NODES else 1) as pool:
        for _ in range(max_iter):
            full = np.flatnonzero(m.any(axis=0))
            few, inner = (full, m[full]) if 4 * len(full) < 3 * n else (None, m)
            change = max(pool.map(rows, range(0, n, ROWS)))
            m, after = after, m
            if change < tol:
                break
    del after, inner
    x, y = np.nonzero(m > FLOW)
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            return own, own[label]


def _powers(steps: int, inflation: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells of each component after so many steps, from rows (component, i, j, w) sorted by component; one component is held at a time."""

    def stepped(i: np.ndarray, j: np.ndarray, w: np.ndarray, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        own, at = np.unique(np.concatenate([i, j]), return_inverse=True)
        m, met = np.zeros((len(own), len(own))), np.zeros((len(own), len(own)), bool)
        m[at[: len(i)], at[len(i) :]] = w
        met[at[: len(i)], at[len(i) :]] = True
        for _ in range(steps):
            vanish = m[met].min() <= 1e-145  # else no product is 0
            m = m @ m
            if vanish:
                paths = met.astype(np.float32)
                met = paths @ paths > 0
            else:
                met = m > 0
            m **= inflation
            m /= m.sum(axis=0)
        for lo in range(0, len(own), rows := max(1, STRIP // len(own))):
            r, c = np.nonzero(met[lo : lo + rows])
            yield pa.record_batch([pa.array(own[lo + r], kind), pa.array(own[c], kind), pa.array(m[lo + r, c])], ["i", "j", "w"])

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, kind = None, [], None
        for batch in batches:
            kind = batch.schema.field(1).type
            component, *cells = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            for lo, hi in pairwise([0, *(np.nonzero(np.diff(component))[0] + 1).tolist(), len(component)]):
                if lo == hi:
                    continue
                if held and component[lo] != key:
                    yield from stepped(*(np.concatenate(x) for x in zip(*held, strict=True)), kind)
                    held = []
                key = component[lo]
                held.append([x[lo:hi] for x in cells])
        if held:
            yield from stepped(*(np.concatenate(x) for x in zip(*held, strict=True)), kind)

    return task


def _local_parts(tiles: DataFrame) -> tuple[int, int]:
    """Partitions for the components that a task holds, and the number of larger ones."""
    n = F.col("n")
    sized = tiles.groupBy("component").agg(F.max("n").alias("n")).agg(F.count_if(n.between(LOCAL_NODES // 16, LOCAL_NODES)).alias("some"), F.count_if(n > LOCAL_NODES).alias("large")).first()
    return max(int(tiles.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, 2 * sized["some"])), sized["large"]


def mcl_iterated(matrix: DataFrame, steps: int, inflation: float = 1.2) -> DataFrame:
    """The matrix after so many steps without pruning.  Components of up to ``LOCAL_NODES`` nodes are worked out whole in a task each, so of these only the
    given cells are shuffled and nothing between is written; their rows aren't written down here, so ``matrix`` has to stay.  Larger ones go step by step by tiles."""
    tiles = mcl_tiles(matrix)
    cells = matrix.join(tiles.select(F.col("node").alias("j"), "component", "n"), "j")
    kind = dict(matrix.dtypes)["i"]
    count, large = _local_parts(tiles)
    inner = cells.where(F.col("n") <= LOCAL_NODES).select("component", "i", "j", F.col("w").cast("double").alias("w"))
    out = inner.repartition(count, "component").sortWithinPartitions("component").mapInArrow(_powers(steps, inflation), f"i {kind}, j {kind}, w double")
    if not large:
        return out
    m = materialise(cells.where(F.col("n") > LOCAL_NODES).select("i", "j", "w"))
    for _ in range(steps):
        after = mcl_step(m, inflation, tiles=tiles)
        release(m)
        m = after
    return out.unionByName(m)


def mcl(edges: DataFrame, inflation: float = 1.2, prune: float = 1e-4, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """Markov clustering.  Components don't touch each other, so each of up to ``WHOLE`` times ``LOCAL_NODES`` nodes is iterated in a task of its own until it settles
    (those of more than ``LOCAL_NODES`` in as many tasks as there are executors); the rest together, by tiles and sums written to the shared folder."""
    start = materialise(mcl_start(edges))
    tiles = mcl_tiles(start)
    cells = start.join(tiles.select(F.col("node").alias("j"), "component", "n"), "j")
    kind = dict(start.dtypes)["i"]

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        own, part = _settled(pdf["i"].to_numpy(), pdf["j"].to_numpy(), pdf["w"].to_numpy(), inflation, prune, max_iter, tol)
        return pd.DataFrame({"node": own, "part": part, "sub": 0})

    count, large = _local_parts(tiles)
    inner = cells.where(F.col("n") <= LOCAL_NODES).select("component", "i", "j", "w").repartition(count, "component")
    parts = materialise(inner.groupBy("component").applyInPandas(task, f"node {kind}, part {kind}, sub int"))
    if large:
        executors = max(1, edges.sparkSession.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)
        whole = cells.where((F.col("n") > LOCAL_NODES) & (F.col("n") <= WHOLE * LOCAL_NODES)).select("component", "i", "j", "w").repartition(executors, "component")
        parts = parts.unionByName(materialise(whole.groupBy("component").applyInPandas(task, f"node {kind}, part {kind}, sub int")))
    beyond = F.col("n") > WHOLE * LOCAL_NODES
    if not large or tiles.where(beyond).isEmpty():
        release(start, tiles)
        return _numbered(parts)
    nodes = tiles.where(beyond).select("node")
    m = materialise(cells.where(beyond).select("i", "j", "w"))
    release(start)
    for _ in range(max_iter):
        after = mcl_step(m, inflation, prune, tiles)
        old = m.select("i", "j", F.col("w").alias("before"))
        change = after.join(old, ["i", "j"], "full").agg(F.max(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("before", F.lit(0.0))))).first()[0]
        release(m)
        m = after
        if change is None or change < tol:
            break
    flows = connected_components(m.where(F.col("w") > FLOW).select(F.col("i").alias("u"), F.col("j").alias("v")))
    rest = nodes.join(flows, "node", "left").select("node", F.coalesce("component", "node").alias("part"), F.lit(0).alias("sub"))
    return _numbered(parts.unionByName(rest))


def cluster_graph(edges: DataFrame, method: str = "infomap", seed: int = 1) -> DataFrame:
    """(node, cl) by the named method."""
    if method == "infomap":
        return map_equation(edges, seed)
    if method == "louvain":
        return louvain(edges, seed)
    if method == "mcl":
        return mcl(edges)
    if method == "slm":
        return smart_local_moving(edges, seed)
    if method == "simap":
        raise NotImplementedError("simap's algorithm isn't public here: import its table with read_cluster_table")
    raise RuntimeError(f"{method} is no known method: {', '.join(METHODS)}")
