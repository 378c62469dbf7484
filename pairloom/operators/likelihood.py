"""Poisson likelihood of binned contacts under a distance model."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.scalar import FAR_SEPARATION, pareto_density


def poisson_term(observed: Column, expected: Column, zero_counts: bool = True) -> Column:
    """One pair's share of the negated log-likelihood; absent contacts count as the expectation, or not at all."""
    a = observed.cast("double")
    some = a * F.ln(a / expected) + expected - a + 0.5 * F.ln(2 * math.pi * a)
    return F.when(a > 0, some).otherwise(expected if zero_counts else F.lit(0.0))


def poisson_loglik(pairs: DataFrame, zero_counts: bool = True) -> DataFrame:
    """One row: log-likelihood of (observed, expected) pairs."""
    return pairs.agg((-F.sum(poisson_term(F.col("observed"), F.col("expected"), zero_counts))).alias("loglik"))


def _side(placed: DataFrame, k: str) -> DataFrame:
    """The columns of a contig or bin table as those of one side of a pair."""
    return placed.select(*[F.col(c).alias(c + k) for c in placed.columns])


def _expected(weight: Column) -> Column:
    """Expectation of a pair of bins; side 1 has the contig of the smaller ix.  As published, each contig's centres take the other one's orientation."""
    between = F.abs(F.col("mid2") - F.col("mid1"))
    return weight * pareto_density(F.abs(between + F.col("ori1") * F.col("center2") - F.col("ori2") * F.col("center1")))


def log_likelihood(extent: DataFrame, bins: DataFrame, order: DataFrame, total: float | None = None, zero_counts: bool = True) -> DataFrame:
    """One row: the log-likelihood of an order.  ``extent`` has b1 <= b2; centres lie within their contig.

    Every pair of bins of two accepted contigs counts, present or not, without being a row: bins of contigs ``FAR_SEPARATION`` or more apart all
    have the far density, so these pairs are counted; nearer contigs are found by blocks of the order and their bins' expectations summed; contacts
    then add what they differ by from absent ones.  Rows grow with the bins times those of their neighbourhood, and with the contacts.
    """
    weight = F.lit(float(total)) if total is not None else F.lit(1.0)
    run = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    own = order.where("mask").withColumn("ahead", F.coalesce(F.sum("length").over(run), F.lit(0)))
    own = own.select("ix", "ori", "ahead", (F.col("ahead") + F.col("length")).alias("end"), (F.col("ahead") + 0.5 * F.col("length")).alias("mid"))
    placed = bins.select("ix", "bin_id", "center").join(own.select("ix", "ori", "mid"), "ix")
    a, b = _side(placed, "1"), _side(placed, "2")
    seen = extent.where("w > 0").join(a.withColumnRenamed("bin_id1", "b1"), "b1").join(b.withColumnRenamed("bin_id2", "b2"), "b2").where("ix1 <> ix2")
    first = F.col("ix1") < F.col("ix2")
    turned = [F.when(first, F.col(f"{c}{k}")).otherwise(F.col(f"{c}{3 - k}")).alias(f"{c}{k}") for c in ("mid", "ori", "center") for k in (1, 2)]
    seen = seen.select("w", *turned).select(F.col("w").alias("observed"), _expected(weight).alias("expected"))
    if not zero_counts:
        return poisson_loglik(seen)
    counts = bins.groupBy("ix").agg(F.count("*").alias("n"))
    sized = own.join(counts, "ix")
    block = F.floor(F.col("ahead") / FAR_SEPARATION)
    x = sized.withColumn("block", F.explode(F.sequence(block, F.floor((F.col("end") + FAR_SEPARATION) / FAR_SEPARATION))))
    y = sized.withColumn("block", block)
    close = _side(x, "x").join(_side(y, "y"), F.col("blockx") == F.col("blocky")).where((F.col("aheadx") < F.col("aheady")) & (F.col("aheady") - F.col("endx") < FAR_SEPARATION))
    close = close.select(F.least("ixx", "ixy").alias("ix1"), F.greatest("ixx", "ixy").alias("ix2"), (F.col("nx") * F.col("ny")).alias("n"))
    near = close.select("ix1", "ix2").join(a.drop("bin_id1"), "ix1").join(b.drop("bin_id2"), "ix2").agg(F.coalesce(F.sum(_expected(weight)), F.lit(0.0)).alias("near"))
    every = sized.agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("every"))
    counted = close.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("counted"))
    # a contact's term beyond the expectation, which is summed for all pairs
    more = seen.agg(F.coalesce(F.sum(poisson_term(F.col("observed"), F.col("expected")) - F.col("expected")), F.lit(0.0)).alias("more"))
    far = weight * pareto_density(F.lit(FAR_SEPARATION)) * (F.col("every") - F.col("counted"))
    return every.crossJoin(counted).crossJoin(near).crossJoin(more).select((-(F.col("more") + F.col("near") + far)).alias("loglik"))
