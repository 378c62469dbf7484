"""Command line: mkmap, cluster, split, communities."""

from __future__ import annotations

import argparse
import logging
import random
import sys

from pyspark.sql import functions as F

from pairloom import session
from pairloom.errors import ApplicationException
from pairloom.operators import clustering, contacts, graph, heatmap, report, sequences
from pairloom.params import MapParams, SplitParams
from pairloom.plans.contact_map import ContactMap
from pairloom.sources import bundle, clusterings, fasta

log = logging.getLogger("pairloom")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pairloom")
    p.add_argument("--version", action="version", version="pairloom 1.0")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--clobber", action="store_true")
    d, s = MapParams(), SplitParams()
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("mkmap", help="alignments and sequences to a contact map")
    a.add_argument("-e", "--enzyme", action="append", required=True)
    a.add_argument("--min-insert", type=int)
    a.add_argument("--min-mapq", type=int, default=d.min_mapq)
    a.add_argument("--strong", type=int, default=d.strong)
    a.add_argument("--bin-size", type=int)
    a.add_argument("--tip-size", type=int)
    a.add_argument("--min-reflen", type=int, default=d.min_len)
    a.add_argument("--min-signal", type=int, default=d.min_sig)
    a.add_argument("FASTA")
    a.add_argument("BAM")
    a.add_argument("OUT")
    b = sub.add_parser("cluster", help="a contact map to clusters and reports")
    b.add_argument("--seed", type=int)
    b.add_argument("--algo", choices=clustering.METHODS, default="infomap")
    b.add_argument("--min-reflen", type=int)
    b.add_argument("--min-signal", type=int)
    b.add_argument("--min-extent", type=int)
    b.add_argument("--max-image", type=int, default=d.max_image)
    for flag in ("no-report", "no-spades", "no-plot", "no-fasta", "only-large"):
        b.add_argument(f"--{flag}", action="store_true")
    b.add_argument("--fasta", required=True)
    b.add_argument("MAP")
    b.add_argument("OUT")
    c = sub.add_parser("split", help="long sequences to near-equal fragments")
    c.add_argument("-s", "--size", type=int, default=s.size)
    c.add_argument("-t", "--threshold", type=float, default=s.threshold)
    c.add_argument("FASTA")
    c.add_argument("OUT", nargs="?")
    e = sub.add_parser("communities", help="a graph to hard or soft communities")
    e.add_argument("--otype", choices=("hard", "soft", "maxaff"), default="hard")
    e.add_argument("--ifmt", choices=("edgelist", "graphml"), default="graphml")
    e.add_argument("--ofmt", choices=("mcl", "graphml"), default="mcl")
    only = e.add_mutually_exclusive_group()
    only.add_argument("--ragbag", action="store_true")
    only.add_argument("--no-isolates", action="store_true")
    e.add_argument("IN")
    e.add_argument("OUT")
    return p


def mkmap(spark, args) -> None:
    params = MapParams(args.min_mapq, args.strong, args.min_insert, args.min_reflen, args.min_signal, bin_size=args.bin_size, tip_size=args.tip_size)
    made = ContactMap.build(spark, args.BAM, args.FASTA, args.enzyme, params)
    if contacts.is_empty(made.seq_map):
        raise ApplicationException("no pair of reads makes a contact: the map is empty")
    for r in made.accounting.sort("reason").collect():
        log.info("%s pairs: %d", r["reason"], r["n_pairs"])
    made.save(args.OUT, args.clobber)


def cluster(spark, args) -> None:
    seed = args.seed if args.seed is not None else random.randrange(10**6, 10**7)
    log.info("seed %d", seed)
    made = ContactMap.load(spark, args.MAP, min_len=args.min_reflen, min_sig=args.min_signal, min_extent=args.min_extent)
    members, clusters = (session.materialise(x) for x in made.cluster(args.algo, seed))
    clusterings.write_lines(report.membership_lines(members, made.contigs), f"{args.OUT}/clustering.mcl")
    bundle.save({"members": members, "clusters": clusters}, {"seed": seed}, f"{args.OUT}/clustering", args.clobber)
    seqs = fasta.read_fasta(spark, args.fasta)
    if not args.no_report:
        stats = report.member_stats(members, made.contigs, seqs, with_coverage=not args.no_spades)
        bundle.write_report(report.cluster_report(stats, clusters), f"{args.OUT}/cluster_report.csv")
    if not args.no_fasta:
        least = made.params.min_extent if args.only_large else None
        bundle.write_cluster_fasta(report.fasta_records(members, clusters, made.contigs, seqs, least), f"{args.OUT}/fasta", clobber=args.clobber)
    if not args.no_plot:
        tiles, ticks = made.tiles(members, clusters, args.max_image)
        tiles.write.mode("overwrite").parquet(f"{args.OUT}/cluster_tiles")
        ticks.write.mode("overwrite").parquet(f"{args.OUT}/cluster_ticks")
        end = ticks.agg(F.max("tick")).first()[0]
        if end:  # the last tick is the picture's side
            heatmap.write_png(spark.read.parquet(f"{args.OUT}/cluster_tiles"), int(end) + made.reduced, f"{args.OUT}/cluster_plot.png")


def split(spark, args) -> None:
    seqs = fasta.read_fasta(spark, args.FASTA, numbered=True)
    pieces = sequences.split_fragments(seqs, args.size, args.threshold)
    fasta.write_fragments(pieces, args.OUT or f"{args.FASTA}.split", args.clobber)
    log.info("%s", sequences.split_stats(seqs, pieces).first().asDict())


def communities(spark, args) -> None:
    edges = clusterings.read_edges(spark, args.IN) if args.ifmt == "edgelist" else clusterings.read_graphml(spark, args.IN)
    edges = session.materialise(edges)
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    kept = edges
    if args.no_isolates or args.ragbag:  # before the search: loops of isolates would count in the whole graph's weight
        alone = graph.isolates(nodes, edges).withColumnRenamed("node", "u")
        kept = session.materialise(edges.join(alone, "u", "left_anti").select("u", "v", "weight"))
    partition = session.materialise(clustering.louvain(kept))
    if args.ragbag:
        partition = graph.with_ragbag(partition, nodes, edges)
    if args.otype == "hard":
        found = partition.select(F.col("cl").alias("comm"), "node", F.lit(1.0).alias("strength"))
    else:
        found = graph.soft_membership(kept, partition, "simple" if args.otype == "soft" else "maxaff")
    if args.ofmt == "mcl":
        clusterings.write_lines(clusterings.community_lines(found), args.OUT)
    else:
        clusterings.write_graphml(found.select(F.concat(F.lit("c"), F.col("comm").cast("string")).alias("u"), F.col("node").alias("v"), F.col("strength").alias("weight")), args.OUT)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = session.build()
    try:
        {"mkmap": mkmap, "cluster": cluster, "split": split, "communities": communities}[args.command](spark, args)
    except ApplicationException as e:
        log.error("%s", e)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
