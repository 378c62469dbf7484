"""FASTA scans and records."""

from __future__ import annotations

import bz2
import gzip
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.errors import ParsingError
from pairloom.operators.sequences import wrapped


def _records(text: DataFrame) -> DataFrame:
    """One row per record from rows that hold a record's text, the leading > cut off or not."""
    body = F.regexp_replace("value", "^>", "")
    header = F.regexp_replace(F.split(body, "\n", 2)[0], r"\s+$", "")
    rest = F.coalesce(F.try_element_at(F.split(body, "\n", 2), F.lit(2)), F.lit(""))
    seq = F.regexp_replace(rest, r"\s", "")
    kept = [c for c in ("seq_no",) if c in text.columns]
    rows = text.where(F.length(F.trim("value")) > 0).select(header.alias("description"), seq.alias("seq"), *kept)
    return rows.select(F.split("description", r"\s")[0].alias("seq_name"), "description", "seq", F.length("seq").alias("length"), *kept)


def read_fasta(spark: SparkSession, path: str, min_len: int | None = None, check_names: bool = False, numbered: bool = False) -> DataFrame:
    """(seq_name, description, seq, length), plain or compressed; records are the rows, so plain files split and load in parallel.

    ``check_names`` looks for names that occur twice and raises; ``numbered`` adds seq_no, which grows along the file.
    """
    if path.lower().endswith((".gz", ".bz2")) and not path.endswith((".gz", ".bz2")):
        out = _odd_suffix(spark, path)
    else:
        rows = spark.read.option("lineSep", "\n>").text(path)
        # where a split begins and the row within it: numbers grow along the file without a pass over it
        place = (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("seq_no")
        out = _records(rows.select("value", place) if numbered else rows)
    if min_len:
        out = out.where(F.col("length") >= min_len)
    if check_names and not out.groupBy("seq_name").count().where("count > 1").isEmpty():
        raise ParsingError(f"a sequence name occurs twice in {path}")
    return out


def _odd_suffix(spark: SparkSession, path: str) -> DataFrame:
    """Compressed files whose suffix Spark doesn't know for its capitals."""

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = (gzip if name.lower().endswith(".gz") else bz2).decompress(raw).decode()
                yield pa.record_batch([pa.array(("\n" + text).split("\n>")[1:], pa.string())], ["value"])

    return _records(spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(unpack, "value string"))


def count_records(spark: SparkSession, path: str) -> int:
    return spark.read.text(path).where(F.col("value").startswith(">")).count()


def fasta_text(records: DataFrame, order: list[str]) -> DataFrame:
    """One row of text per record (record_id, description, seq), sequences at 60 letters a line."""
    head = F.concat(F.lit(">"), "record_id", F.when(F.length("description") > 0, F.concat(F.lit(" "), "description")).otherwise(F.lit("")))
    return records.sort(*order).select(F.concat(head, F.lit("\n"), wrapped(F.col("seq"))).alias("value"))


def write_fragments(fragments: DataFrame, path: str, clobber: bool = False, compression: str | None = None) -> None:
    """Fragments as FASTA in the order of their sequences' numbers (by name if they have none); an existing target is an error unless ``clobber``."""
    by = "seq_no" if "seq_no" in fragments.columns else "seq_name"
    rows = fragments.select(by, "start", F.col("frag_id").alias("record_id"), F.lit("").alias("description"), "seq")
    writer = fasta_text(rows, [by, "start"]).write.mode("overwrite" if clobber else "error")
    (writer.option("compression", compression) if compression else writer).text(path)
