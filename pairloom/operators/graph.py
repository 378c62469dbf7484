"""The contact graph: edges (u, v, weight), u <= v."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions.scalar import plogp
from pairloom.operators.normalise import scaled_to_max


def contact_edges(matrix: DataFrame, scale: bool = True) -> DataFrame:
    """Edges of a symmetric map; loops stay."""
    m = scaled_to_max(matrix) if scale else matrix
    return m.where("i <= j AND w > 0").select(F.col("i").alias("u"), F.col("j").alias("v"), F.col("w").alias("weight"))


def node_attributes(contigs: DataFrame, report: DataFrame) -> DataFrame:
    """(node, name, coverage, sites, length): contigs that edges speak of, with what a sequence report (by name) says of them."""
    return contigs.select(F.col("ix").alias("node"), "name").join(report.select("name", "coverage", "sites", "length"), "name").select("node", "name", "coverage", "sites", "length")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from both of its ends, a loop once."""
    return edges.select("u", "v", "weight").unionByName(edges.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "weight"))


def isolates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge to another node."""
    tied = both_ways(edges.where("u <> v")).select(F.col("u").alias("node")).distinct()
    return nodes.join(tied, "node", "left_anti")


def top_neighbours(edges: DataFrame, n: int) -> DataFrame:
    """(u, v, weight, rank): the n + 1 heaviest neighbours of each node, itself included if it has a loop (ties: the smaller node)."""
    heavy = Window.partitionBy("u").orderBy(F.desc("weight"), "v")
    return both_ways(edges).withColumn("rank", F.row_number().over(heavy)).where(F.col("rank") <= n + 1)


def neighbourhood(edges: DataFrame, n: int = 4, hops: int = 1) -> DataFrame:
    """(u, v): nodes met from u in ``hops`` steps beyond its heaviest neighbours; u itself is not passed through."""
    top = top_neighbours(edges, n).select("u", "v")
    found = top
    edge = top.select(F.col("u").alias("mid"), F.col("v").alias("far"))
    front = top
    for _ in range(hops):
        front = front.where("u <> v").join(edge, F.col("v") == F.col("mid")).select("u", F.col("far").alias("v")).distinct()
        found = found.unionByName(front).distinct()
    return found


def degenerates(edges: DataFrame, contigs: DataFrame, fold_max: float, min_len: int = 0) -> DataFrame:
    """(ix, is_degenerate, cov, local_cov, fold): coverage against the geometric mean of the neighbourhood's.

    ``contigs`` has ix, length, cov; short contigs and those without edges are left out.
    """
    near = neighbourhood(edges).join(contigs.select(F.col("ix").alias("v"), F.col("cov").alias("c")), "v")
    local = near.groupBy(F.col("u").alias("ix")).agg(F.exp(F.avg(F.ln("c"))).alias("local_cov"))
    out = contigs.where(F.col("length") >= min_len).join(local, "ix")
    fold = F.col("cov") / F.col("local_cov")
    return out.select("ix", (fold > fold_max).alias("is_degenerate"), "cov", "local_cov", fold.alias("fold"))


def strengths(edges: DataFrame) -> DataFrame:
    """(node, strength): weights of a node's edges, loops twice."""
    ends = edges.select(F.col("u").alias("node"), "weight").unionByName(edges.select(F.col("v").alias("node"), "weight"))
    return ends.groupBy("node").agg(F.sum("weight").alias("strength"))


def modularity(edges: DataFrame, partition: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row: the modularity of a partition (node, cl)."""
    a = partition.select(F.col("node").alias("u"), F.col("cl").alias("cu"))
    b = partition.select(F.col("node").alias("v"), F.col("cl").alias("cv"))
    inner = edges.join(a, "u").join(b, "v").groupBy(F.col("cu").alias("cl")).agg(F.sum(F.when(F.col("cu") == F.col("cv"), F.col("weight")).otherwise(0.0)).alias("inside"))
    total = strengths(edges).join(partition, "node").groupBy("cl").agg(F.sum("strength").alias("s"))
    whole = edges.agg(F.sum("weight").alias("m"))
    parts = total.join(inner, "cl", "left").join(F.broadcast(whole))  # one row
    share = F.col("s") / (2 * F.col("m"))
    return parts.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - resolution * share * share).alias("modularity"))


def codelength(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """One row: bits per step of the two-level map equation for a partition (node, cl); loops carry no flow."""
    flow = edges.where("u <> v")
    s = strengths(flow)
    whole = flow.agg((2 * F.sum("weight")).alias("w2"))
    node = s.join(F.broadcast(whole)).select("node", (F.col("strength") / F.col("w2")).alias("p"))  # one row
    a = partition.select(F.col("node").alias("u"), F.col("cl").alias("cu"))
    b = partition.select(F.col("node").alias("v"), F.col("cl").alias("cv"))
    cut = both_ways(flow).join(a, "u").join(b, "v").where("cu <> cv").groupBy(F.col("cu").alias("cl")).agg(F.sum("weight").alias("cut"))
    inside = node.join(partition, "node").groupBy("cl").agg(F.sum("p").alias("p"))
    module = inside.join(cut, "cl", "left").join(F.broadcast(whole)).select("p", (F.coalesce("cut", F.lit(0.0)) / F.col("w2")).alias("q"))  # one row
    modules = module.agg(F.sum("q").alias("q"), F.sum(plogp(F.col("q"))).alias("lq"), F.sum(plogp(F.col("q") + F.col("p"))).alias("lqp"))
    nodes = node.agg(F.sum(plogp(F.col("p"))).alias("lp"))
    return modules.join(nodes).select((plogp(F.col("q")) - 2 * F.col("lq") - F.col("lp") + F.col("lqp")).alias("codelength"))


def members_inside(edges: DataFrame, partition: DataFrame) -> DataFrame:
    """Edges within one community, with it: the graph taken apart."""
    a = partition.select(F.col("node").alias("u"), F.col("cl").alias("cl"))
    b = partition.select(F.col("node").alias("v"), F.col("cl").alias("cv"))
    return edges.join(a, "u").join(b, "v").where("cl = cv").select("cl", "u", "v", "weight")


def soft_membership(edges: DataFrame, partition: DataFrame, method: str = "simple") -> DataFrame:
    """(comm, node, strength): own community 1, further ones 0.5.

    simple: any edge between communities makes both ends members of the other.  maxaff: only an edge that is as heavy as any of the end's own.
    """
    own = partition.select(F.col("cl").alias("comm"), "node", F.lit(1.0).alias("strength"))
    a = partition.select(F.col("node").alias("u"), F.col("cl").alias("cu"))
    b = partition.select(F.col("node").alias("v"), F.col("cl").alias("cv"))
    rows = both_ways(edges).join(a, "u").join(b, "v")
    if method == "maxaff":
        top = both_ways(edges).groupBy("u").agg(F.max("weight").alias("top"))
        rows = rows.join(top, "u").where("weight = top")
    elif method != "simple":
        raise RuntimeError(f"{method} is no known method: simple or maxaff is")
    further = rows.where("cu <> cv").select(F.col("cv").alias("comm"), F.col("u").alias("node"), F.lit(0.5).alias("strength"))
    return own.unionByName(further).groupBy("comm", "node").agg(F.max("strength").alias("strength"))


def with_ragbag(partition: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, cl): isolates gathered in one more community, numbered after the last."""
    alone = isolates(nodes, edges)
    rest = partition.join(alone, "node", "left_anti")
    last = rest.agg(F.coalesce(F.max("cl"), F.lit(-1)).alias("last"))
    return rest.select("node", "cl").unionByName(alone.join(F.broadcast(last)).select("node", (F.col("last") + 1).cast(rest.schema["cl"].dataType).alias("cl")))  # one row
