"""Maps of sequence ends: (i, j, k, l, w), k and l the end of contig i and j (0 head, 1 tail)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.contacts import max_offdiag


def count_tips(classified: DataFrame) -> DataFrame:
    """Upper half of the map of ends."""
    return classified.where("reason = 'accepted'").groupBy("i", "j", "k", "l").agg(F.count("*").alias("w"))


def symmetrize_tips(upper: DataFrame) -> DataFrame:
    """(i, j, k, l) also as (j, i, l, k) for different contigs; blocks of one contig stay."""
    mirror = upper.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("l").alias("k"), F.col("k").alias("l"), "w")
    return upper.select("i", "j", "k", "l", "w").unionByName(mirror).groupBy("i", "j", "k", "l").agg(F.sum("w").alias("w"))


def marginal(tips: DataFrame) -> DataFrame:
    """The ends of each contig pair summed."""
    return tips.groupBy("i", "j").agg(F.sum("w").alias("w"))


def flatten(tips: DataFrame) -> DataFrame:
    """As a map of ends numbered 2 i + k."""
    return tips.select((2 * F.col("i") + F.col("k")).alias("i"), (2 * F.col("j") + F.col("l")).alias("j"), "w")


def tip_signal(tips: DataFrame, contigs: DataFrame) -> DataFrame:
    return max_offdiag(marginal(tips), contigs)


def normalise_by_length(tips: DataFrame, contigs: DataFrame, tip: int) -> DataFrame:
    """Counts scaled up for contigs shorter than an end."""
    a = contigs.select(F.col("ix").alias("i"), F.col("length").alias("la"))
    b = contigs.select(F.col("ix").alias("j"), F.col("length").alias("lb"))
    scale = F.lit(float(tip * tip)) / (F.least(F.lit(tip), "la").cast("double") * F.least(F.lit(tip), "lb"))
    return tips.join(a, "i").join(b, "j").select("i", "j", "k", "l", (F.col("w") * scale).alias("w"))


def normalise_by_site(tips: DataFrame, contigs: DataFrame) -> DataFrame:
    """Counts by the sites of the two ends; ``contigs.sites`` holds those of head and tail."""
    a = contigs.select(F.col("ix").alias("i"), F.col("sites").alias("sa"))
    b = contigs.select(F.col("ix").alias("j"), F.col("sites").alias("sb"))
    x = F.greatest(F.get("sa", F.col("k")), F.lit(1))
    y = F.greatest(F.get("sb", F.col("l")), F.lit(1))
    return tips.join(a, "i").join(b, "j").select("i", "j", "k", "l", (F.col("w") / (x * y).cast("double")).alias("w"))
