"""From alignments to classified read pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.scalar import aligned_length, outer_op
from pairloom.params import MapParams

UNMAPPED, REVERSE, SECONDARY, READ2, SUPPLEMENTARY, PROPER = 4, 16, 256, 128, 2048, 2
REASONS = ("accepted", "not_tip", "short_insert", "ref_excluded", "poor_match", "median_excluded", "end_buffered")


def _flag(bit: int) -> Column:
    return F.col("flag").bitwiseAND(F.lit(bit)) != 0


def informative(alignments: DataFrame) -> DataFrame:
    """Mapped primary alignments with strand, aligned length and 5' position."""
    kept = alignments.where(F.col("flag").bitwiseAND(F.lit(UNMAPPED | SECONDARY | SUPPLEMENTARY)) == 0)
    kept = kept.withColumn("reverse", _flag(REVERSE)).withColumn("alen", aligned_length(F.col("cigar")))
    return kept.withColumn("pos5", F.when(F.col("reverse"), F.col("pos") + F.col("alen")).otherwise(F.col("pos")))


def matches(params: MapParams) -> Column:
    """Whether an alignment is good enough: mapping quality, and a long matching op at its 5' end if ``strong``."""
    good = F.col("mapq") >= params.min_mapq
    if params.strong:
        end = outer_op(F.col("cigar"), F.col("reverse"))
        good = good & F.coalesce((end["op"] == 0) & (end["len"] >= params.strong), F.lit(False))
    return good


def mate_pairs(kept: DataFrame, params: MapParams) -> DataFrame:
    """Consecutive alignments of a name, two by two; the odd one at the end is left.

    One shuffle and sort by name: the mate is the next row of the same window, so no second aggregation is needed.
    """
    mate = F.struct("refid", "pos", "pos5", matches(params).alias("good"), _flag(READ2).alias("read2"), _flag(PROPER).alias("proper"), "mapq")
    order = Window.partitionBy("qname").orderBy("rec_no")
    rows = kept.select("qname", "rec_no", mate.alias("r1"))
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("r2", F.lead("r1").over(order))
    paired = rows.where((F.col("n") % 2 == 1) & F.col("r2").isNotNull())
    swapped = F.col("r1.read2")
    return paired.select("qname", "rec_no", F.when(swapped, F.col("r2")).otherwise(F.col("r1")).alias("r1"), F.when(swapped, F.col("r1")).otherwise(F.col("r2")).alias("r2"))


def classify(pairs: DataFrame, contigs: DataFrame, params: MapParams) -> DataFrame:
    """Pairs with their contigs and the reason that keeps or drops them, the mate of the lower contig first.

    ``contigs`` (refid, ix, length) is the dimension of accepted references.  Its size is Spark's to judge: it is broadcast if it is small
    enough, else joined by shuffling.
    """
    dim = contigs.select("refid", "ix", "length")
    d1 = dim.select(F.col("refid").alias("refid1"), F.col("ix").alias("ix1"), F.col("length").alias("len1"))
    d2 = dim.select(F.col("refid").alias("refid2"), F.col("ix").alias("ix2"), F.col("length").alias("len2"))
    joined = pairs.join(d1, F.col("r1.refid") == F.col("refid1"), "left").join(d2, F.col("r2.refid") == F.col("refid2"), "left")
    short = F.lit(False)
    if params.min_insert:
        short = F.col("r1.proper") & (F.col("r2.pos") - F.col("r1.pos") < params.min_insert)
    reason = (
        F.when(F.col("ix1").isNull() | F.col("ix2").isNull(), "ref_excluded")
        .when(~(F.col("r1.good") & F.col("r2.good")), "poor_match")
        .when(short, "short_insert")
    )
    flip = F.col("ix2") < F.col("ix1")
    ends = {}
    for to, a, b in (("i", "ix1", "ix2"), ("p_i", "r1.pos5", "r2.pos5"), ("len_i", "len1", "len2")):
        ends[to] = F.when(flip, F.col(b)).otherwise(F.col(a)).alias(to)
        other = to.replace("i", "j") if to != "i" else "j"
        ends[other] = F.when(flip, F.col(a)).otherwise(F.col(b)).alias(other)
    out = joined.select("qname", "rec_no", *ends.values(), reason.alias("reason"))
    if params.tip_size:
        k, m = tip_side(F.col("p_i"), F.col("len_i"), params.tip_size), tip_side(F.col("p_j"), F.col("len_j"), params.tip_size)
        out = out.withColumn("k", k).withColumn("l", m)
        not_tip = F.when(F.col("reason").isNull() & (F.col("k").isNull() | F.col("l").isNull()), "not_tip")
        out = out.withColumn("reason", F.coalesce("reason", not_tip))
    return out.withColumn("reason", F.coalesce("reason", F.lit("accepted")))


def tip_side(pos: Column, length: Column, tip: int) -> Column:
    """0 at the head of a contig, 1 at its tail, null between (or exactly in the middle of a short one)."""
    long_one = F.when(pos < tip, F.lit(0)).when(pos > length - tip, F.lit(1))
    short_one = F.when(pos < length - pos, F.lit(0)).when(length - pos < pos, F.lit(1))
    return F.when(length > 2 * tip, long_one).otherwise(short_one)


def accounting(classified: DataFrame) -> DataFrame:
    """Pairs by reason; every reason has a row."""
    labels = classified.sparkSession.createDataFrame([(r,) for r in REASONS], "reason string")
    counts = classified.groupBy("reason").agg(F.count("*").alias("n_pairs"))
    return F.broadcast(labels).join(counts, "reason", "left").select("reason", F.coalesce("n_pairs", F.lit(0)).cast("bigint").alias("n_pairs"))
