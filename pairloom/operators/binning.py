"""Bins along contigs and the binned (extent) map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.scalar import mean_of


def bin_count(length: Column, size: int) -> Column:
    n = F.greatest(F.floor(length / size), F.lit(1)).cast("int")
    more = (length % size != 0) & (length.cast("double") / size - n >= 0.5)
    return F.when(more, n + 1).otherwise(n)


def edge(k: Column, n: Column, length: Column) -> Column:
    """The k-th of n + 1 even edges, cut to whole bases; the last is the length."""
    return F.when(k == n, length).otherwise(F.floor(k * (length.cast("double") / n))).cast("int")


def extent_bins(contigs: DataFrame, size: int) -> DataFrame:
    """(ix, bin_id, bin_no, left_edge, right_edge, center): bins of about ``size``, numbered through all contigs.

    Centres are measured from the contig's middle and use the width of its first bin.
    """
    n = bin_count(F.col("length"), size)
    order = Window.orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    first = contigs.select("ix", "length", n.alias("n_bins")).withColumn("first_bin", F.coalesce(F.sum("n_bins").over(order), F.lit(0)))
    bins = first.select("*", F.explode(F.sequence(F.lit(0), F.col("n_bins") - 1)).alias("bin_no"))
    left = edge(F.col("bin_no"), F.col("n_bins"), F.col("length"))
    right = edge(F.col("bin_no") + 1, F.col("n_bins"), F.col("length"))
    width = edge(F.lit(1), F.col("n_bins"), F.col("length"))
    return bins.select(
        "ix", (F.col("first_bin") + F.col("bin_no")).cast("int").alias("bin_id"), "bin_no", left.alias("left_edge"), right.alias("right_edge"),
        (left + 0.5 * width - 0.5 * F.col("length")).alias("center"),
    )


def bin_of(pos: Column, length: Column, n: Column) -> Column:
    """The bin that holds a position: the first whose right edge isn't below it, the last beyond the end.

    The even edges give a guess that is at most one off, so no range join is needed.
    """
    guess = F.least(F.greatest(F.ceil(pos * n / length.cast("double")) - 1, F.lit(0)), n - 1).cast("int")
    lower = F.greatest(guess - 1, F.lit(0))
    step = F.when(edge(lower + 1, n, length) >= pos, lower).when(edge(guess + 1, n, length) >= pos, guess).otherwise(F.least(guess + 1, n - 1))
    return step.cast("int")


def extent_map(classified: DataFrame, contigs: DataFrame, size: int) -> DataFrame:
    """(b1, b2, w), b1 <= b2: pairs by bins.  Pairs that fail only the tip test count too."""
    n = bin_count(F.col("length"), size)
    before = Window.orderBy("ix").rowsBetween(Window.unboundedPreceding, -1)
    first = contigs.select("ix", n.alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("int"))
    a = first.select(F.col("ix").alias("i"), F.col("n").alias("n_i"), F.col("first").alias("f_i"))
    b = first.select(F.col("ix").alias("j"), F.col("n").alias("n_j"), F.col("first").alias("f_j"))
    rows = classified.where("reason IN ('accepted', 'not_tip')").join(a, "i").join(b, "j")
    x = F.col("f_i") + bin_of(F.col("p_i"), F.col("len_i"), F.col("n_i"))
    y = F.col("f_j") + bin_of(F.col("p_j"), F.col("len_j"), F.col("n_j"))
    return rows.select(F.least(x, y).alias("b1"), F.greatest(x, y).alias("b2")).groupBy("b1", "b2").agg(F.count("*").alias("w"))


def extent_to_seq(upper: DataFrame, bins: DataFrame) -> DataFrame:
    """Binned contacts summed by contig pair (i <= j); of a contig with itself each bin pair counts once."""
    a = bins.select(F.col("bin_id").alias("b1"), F.col("ix").alias("i"))
    b = bins.select(F.col("bin_id").alias("b2"), F.col("ix").alias("j"))
    return upper.join(a, "b1").join(b, "b2").groupBy("i", "j").agg(F.sum("w").alias("w"))


def symmetric_bins(upper: DataFrame) -> DataFrame:
    return upper.select("b1", "b2", "w").unionByName(upper.where("b1 <> b2").select(F.col("b2").alias("b1"), F.col("b1").alias("b2"), "w"))


def normalise_extent(matrix: DataFrame, bins: DataFrame, contigs: DataFrame, mean: str = "geometric") -> DataFrame:
    """Counts by thousand bases of the mean length of the two contigs."""
    owner = bins.select("bin_id", "ix").join(contigs.select("ix", "length"), "ix")
    a = owner.select(F.col("bin_id").alias("b1"), F.col("length").alias("la"))
    b = owner.select(F.col("bin_id").alias("b2"), F.col("length").alias("lb"))
    scale = 1e-3 * mean_of(mean)(F.col("la").cast("double"), F.col("lb").cast("double"))
    return matrix.join(a, "b1").join(b, "b2").select("b1", "b2", (F.col("w") / scale).alias("w"))


def compressed_bins(bins: DataFrame, mask: DataFrame) -> DataFrame:
    """(bin_id, dense_bin): bins of accepted contigs without gaps."""
    kept = bins.join(mask.where("accepted").select("ix"), "ix")
    return kept.select("bin_id", "ix", "bin_no", (F.row_number().over(Window.orderBy("bin_id")) - 1).cast("int").alias("dense_bin"))


def compress_extent(matrix: DataFrame, bins: DataFrame, mask: DataFrame) -> DataFrame:
    dim = compressed_bins(bins, mask)
    return _renumber(matrix, dim.select("bin_id", F.col("dense_bin").alias("to")))


def permuted_bins(bins: DataFrame, ordering: DataFrame) -> DataFrame:
    """(bin_id, to): where each bin goes when its contig goes to (rank, ori); bins of a reversed contig run backwards."""
    sizes = bins.groupBy("ix").agg(F.count("*").alias("n")).join(ordering, "ix")
    before = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    place = F.col("start") + F.when(F.col("ori") > 0, F.col("bin_no")).otherwise(F.col("n") - 1 - F.col("bin_no"))
    return bins.join(placed, "ix").select("bin_id", place.cast("int").alias("to"))


def permute_extent(matrix: DataFrame, bins: DataFrame, ordering: DataFrame) -> DataFrame:
    return _renumber(matrix, permuted_bins(bins, ordering))


def _renumber(matrix: DataFrame, to: DataFrame) -> DataFrame:
    a = to.select(F.col("bin_id").alias("b1"), F.col("to").alias("t1"))
    b = to.select(F.col("bin_id").alias("b2"), F.col("to").alias("t2"))
    return matrix.join(a, "b1").join(b, "b2").select(F.col("t1").alias("b1"), F.col("t2").alias("b2"), "w")
