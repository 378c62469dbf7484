"""Normalisation and balancing of maps (i, j, w), both halves."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.scalar import mean_of
from pairloom.session import materialise, release

#: Cells of a map (12 to 24 bytes each) up to which its factors are sought by one task; they are counted first.
LOCAL_CELLS = 4_000_000
#: Damped steps before Newton's, steps of conjugate gradients for one of these at most, the part of the residual that they leave, and the largest
#: change of a factor's logarithm in one.
DAMPED, GRADIENTS, LEFT, REACH = 100, 500, 1e-2, 2.0


def site_floor(sites: Column) -> Column:
    """Sites, at least one."""
    return F.greatest(sites, F.lit(1))


def _both(matrix: DataFrame, contigs: DataFrame, column: str) -> DataFrame:
    a = contigs.select(F.col("ix").alias("i"), F.col(column).alias("x"))
    b = contigs.select(F.col("ix").alias("j"), F.col(column).alias("y"))
    return matrix.join(a, "i").join(b, "j")


def by_sites(matrix: DataFrame, contigs: DataFrame) -> DataFrame:
    """Counts divided by the product of the contigs' sites."""
    scale = (site_floor(F.col("x")) * site_floor(F.col("y"))).cast("double")
    return _both(matrix, contigs, "sites").select("i", "j", (F.col("w") / scale).alias("w"))


def by_length(matrix: DataFrame, contigs: DataFrame, mean: str = "geometric") -> DataFrame:
    """Counts by thousand bases of the contigs' mean length."""
    scale = 1e-3 * mean_of(mean)(F.col("x").cast("double"), F.col("y").cast("double"))
    return _both(matrix, contigs, "length").select("i", "j", (F.col("w") / scale).alias("w"))


def scaled(matrix: DataFrame, scale: DataFrame) -> DataFrame:
    """Cells times the factors (ix, x) of their row and column."""
    rest = [c for c in matrix.columns if c not in ("i", "j", "w")]
    return _both(matrix, scale, "x").select("i", "j", *rest, (F.col("w") * F.col("x") * F.col("y")).alias("w"))


def working_copy(matrix: DataFrame, contigs: DataFrame) -> DataFrame:
    """The map that is balanced: diagonal cells that are absent or 0 become 1."""
    diagonal = matrix.where("i = j AND w <> 0").select(F.col("i").alias("ix"), "w")
    ones = contigs.select("ix").join(diagonal, "ix", "left").select(F.col("ix").alias("i"), F.col("ix").alias("j"), F.coalesce(F.col("w").cast("double"), F.lit(1.0)).alias("w"))
    return matrix.where("i <> j").select("i", "j", F.col("w").cast("double").alias("w")).unionByName(ones)


def times(matrix: DataFrame, x: DataFrame) -> DataFrame:
    """(ix, y): matrix times vector (ix, x)."""
    v = x.select(F.col("ix").alias("j"), F.col("x"))
    return matrix.join(v, "j").groupBy(F.col("i").alias("ix")).agg(F.sum(F.col("w") * F.col("x")).alias("y"))


def start_vector(work: DataFrame) -> DataFrame:
    return work.groupBy(F.col("i").alias("ix")).agg((1 / F.sqrt(F.sum("w"))).alias("x"))


def balance_step(work: DataFrame, x: DataFrame) -> DataFrame:
    """x <- sqrt(x / (M x)): the damped symmetric fixed point."""
    return x.join(times(work, x), "ix").select("ix", F.sqrt(F.col("x") / F.col("y")).alias("x"))


def residual(work: DataFrame, x: DataFrame) -> DataFrame:
    """Sum of (1 - x (M x))^2."""
    off = 1 - F.col("x") * F.col("y")
    return x.join(times(work, x), "ix").agg(F.sum(off * off).alias("residual"))


def _newton_local(times: Callable[[np.ndarray], np.ndarray], x: np.ndarray, v: np.ndarray, enough: float) -> np.ndarray:
    """x after a step of Newton's method in log x: (X M X + diag v) d = 1 - v by conjugate gradients, which sparse, nearly bipartite maps need."""
    r, d = 1 - v, np.zeros(len(x))
    p = r / v
    rho, goal = float((r * p).sum()), max(LEFT * LEFT * float((r * r).sum()), enough)
    for _ in range(GRADIENTS):
        q = x * times(x * p) + v * p
        alpha = rho / float((p * q).sum())
        d += alpha * p
        r = r - alpha * q
        if float((r * r).sum()) <= goal:
            break
        before, rho = rho, float((r * r / v).sum())
        p = r / v + rho / before * p
    return x * np.exp(np.clip(d, -REACH, REACH))


def _solved(times: Callable[[np.ndarray], np.ndarray], x: np.ndarray, tol: float, max_iter: int) -> tuple[np.ndarray, int]:
    """(factors, steps), steps -1 if ``max_iter`` weren't enough and -2 if they diverged.  A step of Newton's that doesn't help is taken back."""
    damped, before = DAMPED, None
    for step in range(max_iter + 1):
        y = times(x)
        left = float(((1 - x * y) ** 2).sum())
        if before is not None and not left < before[2]:
            (x, y, left), damped = before, DAMPED
        before = None
        if not math.isfinite(left):
            return x, -2
        if left <= tol * tol:
            return x, step
        if damped:
            x, damped = np.sqrt(x / y), damped - 1
        else:
            before = (x, y, left)
            x = _newton_local(times, x, x * y, tol * tol / 4)
    return x, -1


def _local_factors(work: DataFrame, tol: float, max_iter: int) -> tuple[DataFrame, int]:
    """The factors of a map of few cells: the same steps as of a large one, in the memory of one task; no cell comes to the driver."""
    kind = dict(work.dtypes)["i"]

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy(zero_copy_only=False) for c in batch.columns] for batch in batches if batch.num_rows]
        if not parts:
            return
        i, j, w = (np.concatenate(c) for c in zip(*parts, strict=True))
        parts.clear()
        ix, at = np.unique(i, return_inverse=True)
        to = np.searchsorted(ix, j)
        x, steps = _solved(lambda x: np.bincount(at, w * x[to], len(ix)), 1 / np.sqrt(np.bincount(at, w, len(ix))), tol, max_iter)
        yield pa.record_batch([pa.array(ix), pa.array(x), pa.array(np.full(len(ix), steps, np.int32))], ["ix", "x", "steps"])

    made = materialise(work.select("i", "j", "w").coalesce(1).mapInArrow(task, f"ix {kind}, x double, steps int"))
    steps = made.agg(F.coalesce(F.max("steps"), F.lit(0))).first()[0]
    if steps < 0:
        release(made)
        raise RuntimeError("balancing diverged" if steps == -2 else f"balancing didn't reach {tol} in {max_iter} steps")
    x = made.select("ix", "x")
    x._materialised_at = made._materialised_at
    return x, steps


def _newton(work: DataFrame, after: DataFrame, enough: float) -> DataFrame:
    """The next vector by ``_newton_local``'s step; each of its inner steps is one join and one sum over the map.  ``after``: (ix, x, v)."""
    t = after.select("ix", "x", "v", F.lit(0.0).alias("d"), (1 - F.col("v")).alias("r"), ((1 - F.col("v")) / F.col("v")).alias("p"))
    first = t.agg(F.sum(F.col("r") * F.col("r")), F.sum(F.col("r") * F.col("p"))).first()
    goal, rho, kept = max(LEFT * LEFT * first[0], enough), first[1], None
    for _ in range(GRADIENTS):
        q = F.col("x") * F.col("y") + F.col("v") * F.col("p")
        made = materialise(t.join(times(work, t.select("ix", (F.col("x") * F.col("p")).alias("x"))), "ix").select(*t.columns, q.alias("q")))
        if kept is not None:
            release(kept)
        kept = made
        alpha = rho / made.agg(F.sum(F.col("p") * F.col("q"))).first()[0]
        r = F.col("r") - alpha * F.col("q")
        sums = made.agg(F.sum(r * r), F.sum(r * r / F.col("v"))).first()
        beta, rho = sums[1] / rho, sums[1]
        t = made.select("ix", "x", "v", (F.col("d") + alpha * F.col("p")).alias("d"), r.alias("r"), (r / F.col("v") + beta * F.col("p")).alias("p"))
        if sums[0] <= goal:
            break
    x = materialise(t.select("ix", (F.col("x") * F.exp(F.least(F.greatest("d", F.lit(-REACH)), F.lit(REACH)))).alias("x")))
    release(kept)
    return x


def _factors(work: DataFrame, tol: float, max_iter: int) -> tuple[DataFrame, int]:
    """The factors by joins, as ``_solved``: each damped step is one join and one sum over the map and gives its residual with the next vector."""
    x = materialise(start_vector(work))
    damped, before = DAMPED, None
    for step in range(max_iter + 1):
        off = 1 - F.col("x") * F.col("y")
        after = materialise(x.join(times(work, x), "ix").select("ix", "x", F.sqrt(F.col("x") / F.col("y")).alias("next"), (F.col("x") * F.col("y")).alias("v"), (off * off).alias("off")))
        left = after.agg(F.sum("off")).first()[0]
        if before is not None:
            if not left < before[1]:
                release(after, x)
                (after, left), damped = before, DAMPED
                x = after.select("ix", "x")
            else:
                release(before[0])
        before = None
        if left is not None and not math.isfinite(left):
            raise RuntimeError("balancing diverged")
        if left is None or left <= tol * tol:
            if "_materialised_at" in x.__dict__:
                release(after)
            else:
                x._materialised_at = after._materialised_at
            return x, step
        release(x)
        if damped:
            x, damped = after.select("ix", F.col("next").alias("x")), damped - 1
            x._materialised_at = after._materialised_at
        else:
            before = (after, left)
            x = _newton(work, after, tol * tol / 4)
    raise RuntimeError(f"balancing didn't reach {tol} in {max_iter} steps")


def balance(matrix: DataFrame, contigs: DataFrame, tol: float = 1e-6, max_iter: int = 1000) -> tuple[DataFrame, DataFrame, int]:
    """The bistochastic form of a symmetric map: (scaled original, scale (ix, x), steps).

    Zero diagonals count as 1 while the factors are sought, so the solution is unique; the original is scaled.  Maps of up to ``LOCAL_CELLS`` cells
    are counted and balanced in memory; larger ones by joins, with vectors in the shared folder (the last is kept, so the plan doesn't grow).
    Damped steps come first; where ``DAMPED`` don't suffice (few and heavy contacts beside light diagonals), Newton's follow.
    """
    work = materialise(working_copy(matrix, contigs).repartition("i"))
    x, steps = (_local_factors if work.count() <= LOCAL_CELLS else _factors)(work, tol, max_iter)
    release(work)
    return scaled(matrix, x), x, steps


def scaled_to_max(matrix: DataFrame) -> DataFrame:
    """Cells divided by the largest, the diagonal included."""
    top = matrix.agg(F.max("w").alias("top"))
    return matrix.join(F.broadcast(top)).select("i", "j", (F.col("w") / F.col("top")).alias("w"))  # one row
