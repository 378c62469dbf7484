"""The corpus pipeline: quality rules, toxicity, near duplicates, benchmark decontamination, mixing.

Each stage takes the documents that its predecessor kept and returns those it keeps, with the columns of ``documents``; the last adds the place
of each document in the mixture.

Defined results of every stage: an empty table gives an empty one; columns beyond doc_id, text and source are carried along whatever their names
(where the last stage's own names are taken, it leads them by underscores); texts are taken whole, however long.

Stages with Python code leave the session with small batches for its workers, which share an executor's memory with its heap and buffers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm import decontamination, mixing, ngram_join, quality_rules, toxicity
from pairloom.llm.common import materialise, small_batches, table
from pairloom.llm.queries import toxicity_model


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the strict quality policy.  Null and empty texts fail it; equal rows stay or go together; a measure at its limit passes."""
    small_batches(spark)
    ledger, _, bits = quality_rules.with_ledger(docs)
    return ledger.where(quality_rules.passes(bits, "strict-1")).select(*[F.col(f"`{c}`") for c in docs.columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; null and empty texts score 0.

    The model is learned from labelled rows of the whole ``documents``; without labels nothing goes.  A score of 0.7 goes.
    """
    small_batches(spark)
    scored, score = toxicity.with_toxicity(docs, toxicity_model(spark, table(spark, sf_dir, "documents"), sf_dir))
    return scored.where(F.col(score) < 0.7).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones: the smallest id, a null id last; of rows that repeat id and text, one.

    Documents without a word are in no group and stay.
    """
    small_batches(spark)
    return ngram_join.one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark; without words or without a benchmark none is.  Exactly a twentieth of hit words goes."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each with its slot in the mixture of sources; null sources are one source; equal rows each have a place."""
    return mixing.mixed(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("ngram_join", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]

#: A learned score, hashed similarity and a schedule aren't SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each one's result is written to the shared folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
