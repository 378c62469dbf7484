"""Orders and orientations of contigs: (ix, pos, ori, mask, length)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def initial(contigs: DataFrame) -> DataFrame:
    """Contigs in their own order, forward, none masked out."""
    return contigs.select("ix", F.col("ix").alias("pos"), F.lit(1).cast("tinyint").alias("ori"), F.lit(True).alias("mask"), "length")


def positions(order: DataFrame) -> DataFrame:
    """Positions without gaps, masked contigs last."""
    rank = Window.orderBy(~F.col("mask"), "pos", "ix")
    return order.withColumn("pos", (F.row_number().over(rank) - 1).cast("int"))


def set_mask(order: DataFrame, mask: DataFrame) -> DataFrame:
    """Masks by (ix, accepted)."""
    m = mask.select("ix", F.col("accepted").alias("m"))
    return positions(order.join(m, "ix").withColumn("mask", F.col("m")).drop("m"))


def mask_one(order: DataFrame, ix: int) -> DataFrame:
    return positions(order.withColumn("mask", F.col("mask") & (F.col("ix") != ix)))


def flip(order: DataFrame, ix: int) -> DataFrame:
    return order.withColumn("ori", F.when(F.col("ix") == ix, -F.col("ori")).otherwise(F.col("ori")).cast("tinyint"))


def shuffle(order: DataFrame, seed: int) -> DataFrame:
    """A random order that depends on the seed and the contigs only."""
    rank = Window.orderBy(~F.col("mask"), F.xxhash64(F.lit(seed), "ix"), "ix")
    return order.withColumn("pos", (F.row_number().over(rank) - 1).cast("int"))


def set_order(order: DataFrame, ordering: DataFrame, implicit_exclusion: bool = False) -> DataFrame:
    """Take over an ordering (rank, ix[, ori]).

    A full ordering names every accepted contig.  With ``implicit_exclusion`` it may name fewer; the rest is masked out.  Contigs that are unknown,
    masked or named twice are an error.
    """
    accepted = order.where("mask").select("ix")
    named = ordering.select("ix")
    if not named.exceptAll(accepted).isEmpty():
        raise ValueError("the ordering names contigs that are unknown, masked out or named twice")
    if not implicit_exclusion and not accepted.exceptAll(named).isEmpty():
        raise ValueError("the ordering lacks accepted contigs")
    given = ordering.select("ix", F.col("rank").alias("new_pos"), *([F.col("ori").alias("new_ori")] if "ori" in ordering.columns else []))
    out = order.join(given, "ix", "left")
    turned = F.coalesce("new_ori", "ori") if "ori" in ordering.columns else F.col("ori")
    out = out.select("ix", F.coalesce("new_pos", "pos").alias("pos"), turned.cast("tinyint").alias("ori"), F.col("new_pos").isNotNull().alias("mask"), "length")
    return positions(out)


def accepted_positions(order: DataFrame) -> DataFrame:
    """(rank, ix, ori) of the accepted contigs in order."""
    rank = Window.orderBy("pos", "ix")
    return order.where("mask").select((F.row_number().over(rank) - 1).cast("int").alias("rank"), "ix", "ori")


def all_positions(order: DataFrame) -> DataFrame:
    return positions(order).select(F.col("pos").alias("rank"), "ix", "ori")


def double_order(ordering: DataFrame) -> DataFrame:
    """An ordering of contigs as one of their ends: 2 ix and 2 ix + 1, swapped where the contig is reversed."""
    ends = ordering.select("rank", "ori", F.posexplode(F.array(2 * F.col("ix"), 2 * F.col("ix") + 1)).alias("k", "ix"))
    k = F.when(F.col("ori") > 0, F.col("k")).otherwise(1 - F.col("k"))
    return ends.select((2 * F.col("rank") + k).alias("rank"), "ix", "ori")


def permute(matrix: DataFrame, ordering: DataFrame) -> DataFrame:
    """Both axes of a map in the given order (P M P^T), by joins."""
    rest = [c for c in matrix.columns if c not in ("i", "j")]
    a = ordering.select(F.col("ix").alias("i"), F.col("rank").alias("ri"))
    b = ordering.select(F.col("ix").alias("j"), F.col("rank").alias("rj"))
    return matrix.join(a, "i").join(b, "j").select(F.col("ri").alias("i"), F.col("rj").alias("j"), *rest)


def before(a: Column, b: Column) -> Column:
    return a < b


def intervening(order: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, between): bases of accepted contigs strictly between two different ones, from prefix sums."""
    run = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    prefix = order.where("mask").select("ix", "pos", "length", F.coalesce(F.sum("length").over(run), F.lit(0)).alias("ahead"))
    x = prefix.select(F.col("ix").alias("a"), F.col("pos").alias("pa"), F.col("length").alias("la"), F.col("ahead").alias("sa"))
    y = prefix.select(F.col("ix").alias("b"), F.col("pos").alias("pb"), F.col("length").alias("lb"), F.col("ahead").alias("sb"))
    gap = F.when(F.col("pa") < F.col("pb"), F.col("sb") - F.col("sa") - F.col("la")).otherwise(F.col("sa") - F.col("sb") - F.col("lb"))
    return pairs.where("a <> b").join(x, "a").join(y, "b").select("a", "b", gap.cast("bigint").alias("between"))
