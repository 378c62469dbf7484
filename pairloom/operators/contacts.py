"""Contact maps as tables (i, j, w): counts, symmetry, signal and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.errors import NoneAcceptedException, ParsingError


def contig_dimension(refs: DataFrame, sequences: DataFrame | None = None, min_len: int = 1000) -> DataFrame:
    """(ix, offset, refid, name, length, sites): references of at least ``min_len``, numbered in the file's order.

    ``sequences`` (seq_name, length, sites) gives the sites; references that it lacks are dropped, differing lengths are an error.  The table has
    a row per contig, not per read; numbering it is one ordered pass.
    """
    kept = refs.where(F.col("length") >= min_len)
    if sequences is not None:
        s = sequences.select(F.col("seq_name").alias("name"), F.col("length").alias("seq_length"), F.col("sites").alias("seq_sites"))
        kept = kept.drop("sites").join(s, "name").withColumn("sites", F.col("seq_sites"))
        same = F.assert_true(F.col("length") == F.col("seq_length"), F.concat(F.lit("lengths of "), F.col("name"), F.lit(" differ between alignments and sequences")))
        kept = kept.where(same.isNull())
    order = Window.orderBy("refid")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return kept.select(
        (F.row_number().over(order) - 1).cast("int").alias("ix"),
        F.coalesce(F.sum("length").over(before), F.lit(0)).cast("bigint").alias("offset"),
        "refid", "name", "length", "sites",
    )


def missing_sequences(refs: DataFrame, sequences: DataFrame, min_len: int = 1000) -> DataFrame:
    """References long enough that have no sequence."""
    return refs.where(F.col("length") >= min_len).join(sequences.select(F.col("seq_name").alias("name")), "name", "left_anti")


def check_unique(refs: DataFrame) -> None:
    if not refs.groupBy("refid").count().where("count > 1").isEmpty():
        raise ParsingError("a reference id occurs twice")


def count_contacts(classified: DataFrame) -> DataFrame:
    """Upper half (i <= j) of the contact map: accepted pairs by contig pair."""
    return classified.where("reason = 'accepted'").groupBy("i", "j").agg(F.count("*").alias("w"))


def symmetrize(upper: DataFrame) -> DataFrame:
    """Both halves; the diagonal stays as it is."""
    rest = [c for c in upper.columns if c not in ("i", "j")]
    return upper.select("i", "j", *rest).unionByName(upper.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), *rest))


def map_weight(symmetric: DataFrame) -> DataFrame:
    return symmetric.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("weight"))


def is_empty(symmetric: DataFrame) -> bool:
    return not map_weight(symmetric).first()["weight"]


def max_offdiag(symmetric: DataFrame, contigs: DataFrame) -> DataFrame:
    """(ix, sig): the largest contact of each contig with another one, 0 if there is none."""
    top = symmetric.where("i <> j").groupBy(F.col("j").alias("ix")).agg(F.max("w").alias("sig"))
    return contigs.select("ix").join(top, "ix", "left").select("ix", F.coalesce("sig", F.lit(0)).alias("sig"))


def acceptance_mask(symmetric: DataFrame, contigs: DataFrame, min_len: int, min_sig: int) -> DataFrame:
    """(ix, length, sig, accepted): long enough and with signal enough (both)."""
    if not min_len or not min_sig:
        raise ValueError("min_len and min_sig must be above zero")
    signal = max_offdiag(symmetric, contigs)
    return contigs.select("ix", "length").join(signal, "ix").withColumn("accepted", (F.col("length") >= min_len) & (F.col("sig") >= min_sig))


def with_external_mask(mask: DataFrame, external: DataFrame) -> DataFrame:
    """The mask and an external one (ix, keep), both."""
    return mask.join(external, "ix", "left").withColumn("accepted", F.col("accepted") & F.coalesce("keep", F.lit(False))).drop("keep")


def mask_counts(mask: DataFrame) -> DataFrame:
    return mask.agg(F.count_if("accepted").alias("n_accepted"), F.count_if(~F.col("accepted")).alias("n_excluded"))


def require_accepted(mask: DataFrame) -> None:
    if mask.where("accepted").isEmpty():
        raise NoneAcceptedException


def gapless(mask: DataFrame) -> DataFrame:
    """(dense_ix, ix): accepted contigs numbered without gaps."""
    order = Window.orderBy("ix")
    return mask.where("accepted").select((F.row_number().over(order) - 1).cast("int").alias("dense_ix"), "ix")


def remap_gapless(values: DataFrame, mask: DataFrame, column: str = "dense_ix") -> DataFrame:
    """``values`` with the contig (ix) that each gapless number in ``column`` stands for."""
    return values.join(gapless(mask).withColumnRenamed("dense_ix", column), column)


def compress(matrix: DataFrame, mask: DataFrame) -> DataFrame:
    """The map of accepted contigs only, renumbered without gaps; further columns are kept."""
    rest = [c for c in matrix.columns if c not in ("i", "j")]
    dim = gapless(mask)
    a = dim.select(F.col("ix").alias("i"), F.col("dense_ix").alias("di"))
    b = dim.select(F.col("ix").alias("j"), F.col("dense_ix").alias("dj"))
    return matrix.join(a, "i").join(b, "j").select(F.col("di").alias("i"), F.col("dj").alias("j"), *rest)


def hermitian_violations(matrix: DataFrame, tol: float = 1e-6) -> DataFrame:
    """Number of cells that differ from their mirror by ``tol`` or more; absent cells are 0."""
    a = matrix.select("i", "j", F.col("w").alias("x"))
    b = matrix.select(F.col("j").alias("i"), F.col("i").alias("j"), F.col("w").alias("y"))
    gap = F.abs(F.coalesce("x", F.lit(0)) - F.coalesce("y", F.lit(0)))
    return a.join(b, ["i", "j"], "full").agg(F.count_if(gap >= tol).cast("bigint").alias("n_violations"))


def is_hermitian(matrix: DataFrame, tol: float = 1e-6) -> bool:
    return hermitian_violations(matrix, tol).first()["n_violations"] == 0
