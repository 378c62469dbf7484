"""Clusters: extents, names, reports and filters.

Members are (cl_id, ix); contigs (ix, name, length); sequences (seq_name, seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.errors import NoRemainingClustersException
from pairloom.functions.scalar import coverage_from_name, digits, gc_percent, zero_padded


def extents(members: DataFrame, contigs: DataFrame) -> DataFrame:
    """(cl_id, size, extent, head): members, their bases and the smallest member."""
    return members.join(contigs.select("ix", "length"), "ix").groupBy("cl_id").agg(F.count("*").alias("size"), F.sum("length").cast("bigint").alias("extent"), F.min("ix").alias("head"))


def ranked(members: DataFrame, contigs: DataFrame, prefix: str = "CL") -> tuple[DataFrame, DataFrame]:
    """(members, clusters) numbered by extent, the largest first; clusters are (cl_id, name, size, extent)."""
    size = extents(members, contigs)
    by = Window.orderBy(F.desc("extent"), "head")
    number = size.withColumn("rank", (F.row_number().over(by) - 1).cast("int")).withColumn("n", F.count("*").over(Window.partitionBy()))
    name = F.concat(F.lit(prefix), zero_padded(F.col("rank") + 1, digits(F.col("n"))))
    clusters = number.select(F.col("rank").alias("cl_id"), name.alias("name"), "size", "extent")
    moved = members.join(number.select("cl_id", "rank"), "cl_id").select(F.col("rank").alias("cl_id"), "ix")
    return moved, clusters


def member_stats(members: DataFrame, contigs: DataFrame, sequences: DataFrame, with_coverage: bool = True, strict: bool = False) -> DataFrame:
    """(cl_id, ix, length, gc[, cov]) from the members' sequences."""
    rows = members.join(contigs.select("ix", "name"), "ix").join(sequences.select(F.col("seq_name").alias("name"), "seq"), "name")
    out = rows.select("cl_id", "ix", F.length("seq").alias("length"), gc_percent(F.col("seq")).alias("gc"), *([coverage_from_name(F.col("name"), strict).alias("cov")] if with_coverage else []))
    return out


def n50(stats: DataFrame) -> DataFrame:
    """(cl_id, n50): the length at which the running sum, longest first, exceeds half of the total."""
    own = Window.partitionBy("cl_id")
    run = own.orderBy(F.desc("length"), "ix").rowsBetween(Window.unboundedPreceding, 0)
    cum = stats.select("cl_id", "length", F.sum("length").over(run).alias("cum"), F.sum("length").over(own).alias("total"))
    return cum.where(2 * F.col("cum") > F.col("total")).groupBy("cl_id").agg(F.max("length").alias("n50"))


def cluster_report(stats: DataFrame, clusters: DataFrame) -> DataFrame:
    """A row per cluster: size, extent, N50, and weighted mean, mean, median and population deviation of GC (and coverage)."""
    aggregates = [F.count("*").alias("size"), F.sum("length").cast("bigint").alias("extent")]
    for c in [c for c in ("gc", "cov") if c in stats.columns]:
        weight = F.when(F.col(c).isNotNull(), F.col("length"))
        aggregates += [
            (F.sum(F.col("length") * F.col(c)) / F.sum(weight)).alias(f"{c}_expect"), F.avg(c).alias(f"{c}_mean"), F.median(c).alias(f"{c}_median"), F.stddev_pop(c).alias(f"{c}_std"),
        ]
    summed = stats.groupBy("cl_id").agg(*aggregates).join(n50(stats), "cl_id")
    rest = [c for c in summed.columns if c not in ("cl_id", "size", "extent", "n50")]
    return clusters.select("cl_id", "name").join(summed, "cl_id").select(F.col("cl_id").alias("id"), "name", "size", "extent", "n50", *rest)


def clusters_without_report(stats: DataFrame, clusters: DataFrame) -> DataFrame:
    return clusters.join(stats.select("cl_id").distinct(), "cl_id", "left_anti")


def filtered(clusters: DataFrame, min_extent: int | None, ordered: DataFrame | None = None) -> DataFrame:
    """Clusters of at least ``min_extent`` (and, if given, only those with an order); an error if none is left."""
    out = clusters.where(F.col("extent") >= min_extent) if min_extent else clusters
    if ordered is not None:
        out = out.join(ordered.select("cl_id").distinct(), "cl_id", "left_semi")
    if out.isEmpty():
        raise NoRemainingClustersException(f"no cluster is left at an extent of {min_extent} or more")
    return out


def concatenated_order(clusters: DataFrame, members: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """(rank, ix, ori): clusters by id, each in its own order (or by ix)."""
    rows = members.join(clusters.select("cl_id"), "cl_id", "left_semi")
    if orders is None:
        rows = rows.withColumn("rank", F.col("ix")).withColumn("ori", F.lit(1))
    else:
        rows = rows.join(orders.select("cl_id", "ix", "rank", "ori"), ["cl_id", "ix"])
    number = Window.orderBy("cl_id", "rank", "ix")
    return rows.select((F.row_number().over(number) - 1).cast("int").alias("rank"), "ix", F.col("ori").cast("tinyint").alias("ori"))


def lost_contigs(contigs: DataFrame, members: DataFrame) -> DataFrame:
    """Contigs in no cluster."""
    return contigs.join(members.select("ix"), "ix", "left_anti")


def membership_lines(members: DataFrame, contigs: DataFrame) -> DataFrame:
    """(line_no, line): the names of each cluster's members, then every lost contig by itself."""
    named = members.join(contigs.select("ix", "name"), "ix")
    lists = named.groupBy("cl_id").agg(F.array_sort(F.collect_list(F.struct("ix", "name"))).alias("m"))
    number = lists.select((F.row_number().over(Window.orderBy("cl_id")) - 1).alias("line_no"), F.array_join(F.transform("m", lambda x: x["name"]), " ").alias("line"))
    clusters = members.select("cl_id").distinct().agg(F.count("*").alias("n"))
    lost = lost_contigs(contigs, members).select((F.row_number().over(Window.orderBy("ix")) - 1).alias("k"), F.col("name").alias("line"))
    after = lost.join(F.broadcast(clusters)).select((F.col("k") + F.col("n")).alias("line_no"), "line")  # one row
    return number.unionByName(after)


def fasta_records(members: DataFrame, clusters: DataFrame, contigs: DataFrame, sequences: DataFrame, min_extent: int | None = None) -> DataFrame:
    """(name, rank, record_id, description, seq) of each cluster's sequences in ascending ix."""
    kept = clusters.where(F.col("extent") >= min_extent) if min_extent else clusters
    rows = members.join(kept.select("cl_id", F.col("name").alias("cluster"), "size"), "cl_id").join(contigs.select("ix", F.col("name").alias("contig")), "ix")
    rows = rows.join(sequences.select(F.col("seq_name").alias("contig"), "seq"), "contig")
    rank = F.row_number().over(Window.partitionBy("cl_id").orderBy("ix"))
    numbered = rows.withColumn("rank", rank)
    record = F.concat("cluster", F.lit("_"), zero_padded(F.col("rank"), digits(F.col("size") + 1)))
    text = F.concat(F.lit("contig:"), F.col("contig"), F.lit(" ori:UNKNOWN length:"), F.length("seq").cast("string"))
    return numbered.select(F.col("cluster").alias("name"), "rank", record.alias("record_id"), text.alias("description"), "seq")
