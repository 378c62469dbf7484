"""Membership files: MCL lists, tables and trees; graphs as edge lists and GraphML; sequence reports.

Line numbers matter in these files.  Lines are read as rows, in splits, and numbered by their place; numbering is one ordered pass, and the files have a
line per cluster or contig.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str, until_blank: bool = True) -> DataFrame:
    """(line_no, line), up to the first blank line."""
    place = (F.col("_metadata.file_block_start") + F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).alias("place")
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place, F.col("value").alias("line"))
    rows = rows.select((F.row_number().over(Window.orderBy("file", "place")) - 1).cast("int").alias("line_no"), "line")
    if not until_blank:
        return rows.where(F.trim("line") != "")
    blank = rows.where(F.trim("line") == "").agg(F.min("line_no").alias("end"))
    return rows.join(F.broadcast(blank)).where(F.col("end").isNull() | (F.col("line_no") < F.col("end"))).select("line_no", "line")  # one row


def read_mcl(spark: SparkSession, path: str) -> DataFrame:
    """(cl, node): the line's number and each of its members."""
    return _lines(spark, path).select(F.col("line_no").alias("cl"), F.explode(F.split(F.trim("line"), r"\s+")).alias("node"))


def read_cluster_table(spark: SparkSession, path: str, seq_col: int | None = 0, cl_col: int = 1) -> DataFrame:
    """(cl, node) from a table; without a sequence column the row's number is the node."""
    t = F.split(F.trim("line"), r"\s+")
    node = F.col("line_no").cast("string") if seq_col is None else F.try_element_at(t, F.lit(seq_col + 1))
    return _lines(spark, path).select(F.try_element_at(t, F.lit(cl_col + 1)).alias("cl"), node.alias("node"))


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """(cl, node) from a tree of modules: a cluster is a path without its last step; numbered by size, the largest first."""
    f = F.split(F.trim("line"), r"\s+")
    steps = F.split(f[0], ":")
    rows = _lines(spark, path, until_blank=False).where(~F.col("line").startswith("#"))
    rows = rows.select(F.array_join(F.slice(steps, F.lit(1), F.size(steps) - 1), ":").alias("key"), F.element_at(f, -1).alias("node"))
    size = rows.groupBy("key").agg(F.count("*").alias("n"))
    number = size.select("key", (F.row_number().over(Window.orderBy(F.desc("n"), "key")) - 1).alias("cl"))
    return rows.join(number, "key").select("cl", "node")


def read_edges(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    return spark.read.schema("u string, v string, weight double").option("sep", sep).csv(path)


def read_graphml(spark: SparkSession, path: str) -> DataFrame:
    """(u, v, weight) from GraphML edges; an edge without a weight weighs 1."""
    rows = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string, data struct<_VALUE:double,_key:string>").load(path)
    return rows.select(F.col("_source").alias("u"), F.col("_target").alias("v"), F.coalesce("data._VALUE", F.lit(1.0)).alias("weight"))


def write_graphml(edges: DataFrame, path: str) -> None:
    """Communities and their members as a directed graph (comm -> node), or any (u, v, weight)."""
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="w" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="directed">'
    line = F.concat(F.lit('<edge source="'), F.col("u").cast("string"), F.lit('" target="'), F.col("v").cast("string"), F.lit('"><data key="w">'), F.col("weight").cast("string"), F.lit("</data></edge>"))
    nodes = edges.select(F.col("u").alias("n")).union(edges.select(F.col("v").alias("n"))).distinct()
    node = F.concat(F.lit('<node id="'), F.col("n").cast("string"), F.lit('"/>'))
    spark = edges.sparkSession
    parts = spark.createDataFrame([(0, head), (3, "</graph></graphml>")], "k int, value string")
    whole = parts.unionByName(nodes.select(F.lit(1).alias("k"), node.alias("value"))).unionByName(edges.select(F.lit(2).alias("k"), line.alias("value")))
    whole.sort("k", "value").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_edges(edges: DataFrame, path: str, sep: str = " ") -> None:
    edges.select(F.concat_ws(sep, F.col("u"), F.col("v"), F.col("weight").cast("string")).alias("value")).write.mode("overwrite").text(path)


def write_lines(lines: DataFrame, path: str, order: str = "line_no") -> None:
    """One file with the lines in order (a line per cluster)."""
    lines.sort(order).select("line").coalesce(1).write.mode("overwrite").text(path)


def community_lines(membership: DataFrame) -> DataFrame:
    """(line_no, line) of (comm, node): members in order, communities by number."""
    lists = membership.groupBy("comm").agg(F.array_sort(F.collect_list("node")).alias("m"))
    return lists.select(F.col("comm").alias("line_no"), F.array_join(F.transform("m", lambda x: x.cast("string")), " ").alias("line"))


def read_sequence_report(spark: SparkSession, path: str) -> DataFrame:
    """(name, coverage, sites, length) from a report {seq_info: {name: {...}}} in JSON, or in YAML if a reader is installed."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    try:
        data = json.loads(text)
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise OSError(f"{path} isn't JSON, and no YAML reader is installed") from None
        data = yaml.safe_load(text)
    rows = [(n, float(v["coverage"]), int(v["sites"]), int(v["length"])) for n, v in data["seq_info"].items()]
    return spark.createDataFrame(rows, "name string, coverage double, sites int, length int")
