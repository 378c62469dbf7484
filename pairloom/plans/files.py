"""Registered queries that write the driver's tables to files and read them back, with SQL for what must come back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators import graph, pairs, report, sequences
from pairloom.plans import adapters
from pairloom.plans import catalogue as c
from pairloom.plans.contact_map import ContactMap
from pairloom.session import materialise, remove, shared_dir
from pairloom.sources import bam, bundle, clusterings, fasta


def round_trip(spark: SparkSession, write: Callable[[str], object], read: Callable[[str], DataFrame]) -> DataFrame:
    """What is read of what was written; the files are deleted."""
    path = f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"
    write(path)
    out = materialise(read(path))
    remove(spark, path)
    return out


def _fasta(spark: SparkSession, sf: str, read: Callable[[str], DataFrame], compression: str = "none") -> DataFrame:
    rows = adapters.sequences(spark, sf).select("ix", F.col("seq_name").alias("record_id"), F.lit("from a table").alias("description"), "seq")
    return round_trip(spark, lambda p: fasta.fasta_text(rows, ["ix"]).write.option("compression", compression).text(p), read)


@c.query(c.seq_sql("SELECT seq_name, seq_name || ' from a table' AS description, length, md5(seq) AS digest FROM seqs"))
def fasta_scan(spark, sf):
    return _fasta(spark, sf, lambda p: fasta.read_fasta(spark, p)).select("seq_name", "description", "length", F.md5("seq").alias("digest"))


@c.query(c.seq_sql("SELECT seq_name, length FROM seqs WHERE length >= 1000"))
def fasta_scan_compressed_min_length(spark, sf):
    return _fasta(spark, sf, lambda p: fasta.read_fasta(spark, p, min_len=1000), "gzip").select("seq_name", "length")


@c.query(c.seq_sql("SELECT count(*) AS n FROM seqs"))
def fasta_count(spark, sf):
    return _fasta(spark, sf, lambda p: spark.range(1).select(F.lit(fasta.count_records(spark, p)).cast("bigint").alias("n")))


@c.query(c.seq_sql("SELECT seq_name, length, CAST(row_number() OVER (ORDER BY ix) - 1 AS INT) AS place FROM seqs"))
def fasta_order_of_records(spark, sf):
    """Records come back in the order of the file, by the numbers that its scan gives."""
    from pyspark.sql import Window

    rows = adapters.sequences(spark, sf).select("ix", F.col("seq_name").alias("record_id"), F.lit("").alias("description"), "seq")
    back = round_trip(spark, lambda p: fasta.fasta_text(rows, ["ix"]).coalesce(1).write.text(p), lambda p: fasta.read_fasta(spark, p, numbered=True))
    return back.select("seq_name", "length", (F.row_number().over(Window.orderBy("seq_no")) - 1).cast("int").alias("place"))


@c.query(c.seq_sql("SELECT seq_name || '.' || s || '_' || e AS frag_id, CAST(e - s AS INT) AS length FROM fr", c._FRAG))
def fragment_files(spark, sf):
    pieces = sequences.split_fragments(adapters.sequences(spark, sf), 500)
    return round_trip(spark, lambda p: fasta.write_fragments(pieces, p, compression="gzip"), lambda p: fasta.read_fasta(spark, p)).select(F.col("seq_name").alias("frag_id"), "length")


def _sam(spark: SparkSession, sf: str) -> DataFrame:
    names = adapters.refs(spark, sf).select("refid", F.col("name").alias("rname"), F.col("length").alias("size"))
    cigar = F.array_join(F.transform("cigar", lambda x: F.concat(x["len"].cast("string"), F.when(x["op"] == 4, F.lit("S")).otherwise(F.lit("M")))), "")
    rows = adapters.alignments(spark, sf).join(names, "refid")
    text = F.concat_ws("\t", *[F.col(x).cast("string") for x in ("qname", "flag", "rname")], (F.col("pos") + 1).cast("string"), F.col("mapq").cast("string"), cigar, *[F.lit(x) for x in ("*", "0", "0", "*", "*")])
    head = names.select(F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), "rname"), F.concat(F.lit("LN:"), F.col("size").cast("string"))).alias("value"))
    first = spark.createDataFrame([("@HD\tVN:1.6\tSO:queryname",)], "value string")
    return first.unionByName(head).unionByName(rows.select(text.alias("value")))


@c.query(c.sql("SELECT name, length FROM refs"))
def sam_header(spark, sf):
    return round_trip(spark, lambda p: _sam(spark, sf).write.text(p), lambda p: bam.sam_references(spark, p).select("name", "length"))


@c.query(c.sql("SELECT CAST(qname AS VARCHAR) AS qname, refs.name, pos, rev AS reverse, CAST(alen AS INT) AS alen, CAST(pos5 AS INT) AS pos5, mapq FROM inf JOIN refs ON inf.refid = refs.refid"))
def sam_informative(spark, sf):
    def read(path: str) -> DataFrame:
        refs = bam.sam_references(spark, path)
        return pairs.informative(bam.read_sam(spark, path, refs)).join(refs.select("refid", "name"), "refid").select("qname", "name", "pos", "reverse", "alen", "pos5", "mapq")

    return round_trip(spark, lambda p: _sam(spark, sf).write.text(p), read)


@c.query(c.sql("SELECT i, j, w FROM sym"))
def saved_map(spark, sf):
    def read(path: str) -> DataFrame:
        back = ContactMap.load(spark, path)
        if back.params != c.PARAMS:
            raise ValueError("the parameters of a map didn't come back")
        return back.seq_map

    return round_trip(spark, lambda p: c.contact_map(spark, sf).save(p), read)


_LINES = """mm AS (SELECT cl_id, ix FROM members WHERE ix % 6 <> 5),
ll AS (SELECT dense_rank() OVER (ORDER BY cl_id) - 1 AS cl, name AS node FROM mm JOIN contigs ON mm.ix = contigs.ix
  UNION ALL SELECT (SELECT count(DISTINCT cl_id) FROM mm) + row_number() OVER (ORDER BY ix) - 1, name FROM contigs WHERE ix NOT IN (SELECT ix FROM mm))"""


@c.query(c.sql("SELECT CAST(cl AS INT) AS cl, node FROM ll", _LINES))
def mcl_file(spark, sf):
    lines = report.membership_lines(c.members(spark, sf).where("ix % 6 <> 5"), c.contigs(spark, sf))
    return round_trip(spark, lambda p: clusterings.write_lines(lines, p), lambda p: clusterings.read_mcl(spark, p)).select(F.col("cl").cast("int").alias("cl"), "node")


def _named_members(spark: SparkSession, sf: str) -> DataFrame:
    return c.members(spark, sf).join(c.contigs(spark, sf).select("ix", "name"), "ix")


@c.query(c.sql("SELECT CAST(cl_id AS VARCHAR) AS cl, name AS node FROM members JOIN contigs ON members.ix = contigs.ix"))
def cluster_table_file(spark, sf):
    rows = _named_members(spark, sf).select(F.concat_ws(" ", "name", F.col("cl_id").cast("string")).alias("line"), F.col("ix").alias("line_no"))
    return round_trip(spark, lambda p: clusterings.write_lines(rows, p), lambda p: clusterings.read_cluster_table(spark, p))


@c.query(c.sql("""SELECT CAST(cl AS INT) AS cl, name AS node FROM members JOIN contigs ON members.ix = contigs.ix
  JOIN (SELECT cl_id, row_number() OVER (ORDER BY count(*) DESC, CAST(cl_id AS VARCHAR)) - 1 AS cl FROM members GROUP BY cl_id) n ON members.cl_id = n.cl_id"""))
def tree_file(spark, sf):
    rows = _named_members(spark, sf).select(F.concat(F.col("cl_id").cast("string"), F.lit(":"), F.col("ix").cast("string"), F.lit(' 0.5 "label" '), "name").alias("line"), F.col("ix").alias("line_no"))
    rows = rows.unionByName(spark.createDataFrame([("# made for a test", -1)], "line string, line_no int"))
    return round_trip(spark, lambda p: clusterings.write_lines(rows, p), lambda p: clusterings.read_tree(spark, p)).select(F.col("cl").cast("int").alias("cl"), "node")


@c.query(c.sql("SELECT CAST(u AS VARCHAR) AS u, CAST(v AS VARCHAR) AS v, weight FROM edges"))
def edge_list_file(spark, sf):
    return round_trip(spark, lambda p: clusterings.write_edges(c.edges(spark, sf), p), lambda p: clusterings.read_edges(spark, p))


@c.query(c.sql("SELECT CAST(u AS VARCHAR) AS u, CAST(v AS VARCHAR) AS v, weight FROM edges"))
def graphml_file(spark, sf):
    return round_trip(spark, lambda p: clusterings.write_graphml(c.edges(spark, sf), p), lambda p: clusterings.read_graphml(spark, p))


def _sequence_report(spark: SparkSession, sf: str) -> DataFrame:
    info = F.map_from_entries(F.collect_list(F.struct("name", F.struct((F.lit(1.5) + F.col("ix") % 37).alias("coverage"), "sites", "length"))))
    text = c.contigs(spark, sf).agg(info.alias("seq_info")).select(F.to_json(F.struct("seq_info")).alias("value"))  # a row per contig in all
    return round_trip(spark, lambda p: text.coalesce(1).write.text(p), lambda p: clusterings.read_sequence_report(spark, p))


@c.query(c.sql("SELECT name, CAST(1.5 + ix % 37 AS DOUBLE) AS coverage, sites, length FROM contigs"))
def sequence_report_file(spark, sf):
    return _sequence_report(spark, sf)


@c.query(c.sql("SELECT ix AS node, name, CAST(1.5 + ix % 37 AS DOUBLE) AS coverage, sites, length FROM contigs"))
def contact_graph_nodes(spark, sf):
    return graph.node_attributes(c.contigs(spark, sf), _sequence_report(spark, sf))


@c.query(c.seq_sql("SELECT CAST(id AS INT) AS id, 'CL' || lpad(CAST(id + 1 AS VARCHAR), CAST(greatest(CAST(ceil(log10(n)) AS INT), 1, length(CAST(id + 1 AS VARCHAR))) AS INT), '0') AS name, CAST(size AS BIGINT) AS size, extent FROM dr", c._DOCS))
def report_file(spark, sf):
    stats, clusters, _ = c._doc_clusters(spark, sf)
    kinds = "id int, name string, size bigint, extent bigint"

    def read(path: str) -> DataFrame:
        rows = spark.read.option("header", True).csv(path)
        return rows.select(*[F.col(x.split()[0]).cast(x.split()[1]) for x in kinds.split(", ")])

    return round_trip(spark, lambda p: bundle.write_report(report.cluster_report(stats, clusters), p), read)


@c.query(c.seq_sql("""SELECT name || '.fna' AS file, name || '_' || lpad(CAST(r AS VARCHAR), CAST(greatest(CAST(ceil(log10(size + 1)) AS INT), 1, length(CAST(r AS VARCHAR))) AS INT), '0') AS seq_name, length, md5(seq) AS digest FROM (
  SELECT cm.*, size, 'CL' || lpad(CAST(id + 1 AS VARCHAR), CAST(greatest(CAST(ceil(log10(n)) AS INT), 1, length(CAST(id + 1 AS VARCHAR))) AS INT), '0') AS name,
    row_number() OVER (PARTITION BY cm.old ORDER BY ix) AS r FROM cm JOIN dr ON cm.old = dr.old)""", c._DOCS))
def cluster_fasta_files(spark, sf):
    seqs = adapters.sequences(spark, sf)
    dim = seqs.select("ix", F.col("seq_name").alias("name"), "length")
    _, clusters, moved = c._doc_clusters(spark, sf)
    records = report.fasta_records(moved, clusters, dim, seqs)

    def read(path: str) -> DataFrame:
        rows = spark.read.option("lineSep", "\n>").text(path).select("value", F.col("_metadata.file_name").alias("file"))
        body = F.regexp_replace("value", "^>", "")
        rows = rows.where(F.length(F.trim("value")) > 0).select("file", F.split(body, r"\s")[0].alias("seq_name"), F.regexp_replace(F.coalesce(F.try_element_at(F.split(body, "\n", 2), F.lit(2)), F.lit("")), r"\s", "").alias("seq"))
        return rows.select("file", "seq_name", F.length("seq").alias("length"), F.md5("seq").alias("digest"))

    return round_trip(spark, lambda p: bundle.write_cluster_fasta(records, p), read)
