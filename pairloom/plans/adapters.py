"""The driver's tables as alignments, contigs and sequences.

A supplier is a contig, an order a read name, a line an alignment, a document a sequence.  The same adapters are given as SQL for comparison.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = "".join("ACGT"[k % 26 % 4] for k in range(52))

REFS = """SELECT CAST(s_suppkey AS INT) AS refid, s_name AS name, CAST(500 + (s_suppkey * 7919) % 60000 AS INT) AS length,
  CAST((s_suppkey * 31) % 13 AS INT) AS sites FROM supplier"""

ALIGNMENTS = """SELECT CAST(l_orderkey AS BIGINT) AS qname,
  CAST(l_linenumber AS BIGINT) * 1000000000000 + l_partkey * 1000000 + l_suppkey AS rec_no,
  CAST((CASE WHEN l_partkey % 17 = 0 THEN 4 ELSE 0 END) + (CASE WHEN l_partkey % 19 = 0 THEN 256 ELSE 0 END)
  + (CASE WHEN l_partkey % 23 = 0 THEN 2048 ELSE 0 END) + (CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END)
  + (CASE WHEN l_linestatus = 'F' THEN 128 ELSE 0 END) + (CASE WHEN l_partkey % 2 = 0 THEN 2 ELSE 0 END) AS INT) AS flag,
  CAST(l_suppkey AS INT) AS refid,
  CAST((l_partkey * 37 + l_linenumber * 101) % (500 + (l_suppkey * 7919) % 60000) AS INT) AS pos,
  CAST(l_quantity AS INT) + 10 AS mapq,
  CASE WHEN l_partkey % 5 = 0 THEN 4 ELSE 0 END AS op1, CAST(5 + l_partkey % 20 AS INT) AS len1, 0 AS op2, CAST(30 + l_partkey % 40 AS INT) AS len2
  FROM lineitem"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "CAST(s_suppkey AS INT) AS refid", "s_name AS name", "CAST(500 + (s_suppkey * 7919) % 60000 AS INT) AS length", "CAST((s_suppkey * 31) % 13 AS INT) AS sites"
    )


def alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    rows = spark.sql(ALIGNMENTS.replace("FROM lineitem", "FROM {view}"), view=view)
    return rows.selectExpr("qname", "rec_no", "flag", "refid", "pos", "mapq", "array(named_struct('op', op1, 'len', len1), named_struct('op', op2, 'len', len2)) AS cigar")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_name, seq, length) from documents; null texts are left out."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").selectExpr(
        "concat('NODE_', doc_id, '_length_', n_chars, '_cov_', doc_id % 100, '.5') AS seq_name",
        f"regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', 'N') AS seq", "CAST(doc_id AS INT) AS ix",
    ).selectExpr("seq_name", "seq", "CAST(length(seq) AS INT) AS length", "ix")


SEQUENCES = f"""SELECT 'NODE_' || doc_id || '_length_' || n_chars || '_cov_' || doc_id % 100 || '.5' AS seq_name,
  regexp_replace(translate(text, '{LETTERS}', '{BASES}'), '[^ACGT]', 'N', 'g') AS seq, CAST(doc_id AS INT) AS ix FROM documents WHERE text IS NOT NULL"""
