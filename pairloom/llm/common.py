"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.session import materialise, release, shared_dir, small_batches

__all__ = ["crc_mod", "let", "materialise", "release", "shared_dir", "small_batches", "table", "unused_name"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's own reader (any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have (compared without case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` applied to ``value``, which is evaluated once per row.

    A lambda variable can't be inlined by the optimizer, so an expensive array is never computed again for each element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def crc_mod(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % m
