"""Worked goldens and row-loop oracles of the contact-map operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pairloom.errors import NoRemainingClustersException, UnknownEnzymeException
from pairloom.functions import scalar
from pairloom.operators import binning, clustering, components, contacts, graph, heatmap, normalise, order, pairs, report, sequences, tips
from pairloom.params import MapParams


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_defaults():
    p = MapParams()
    assert (p.min_mapq, p.strong, p.min_len, p.min_sig, p.min_extent, p.max_image, p.min_insert, p.bin_size) == (60, 10, 1000, 5, 50_000, 4000, None, None)


def test_split_goldens(spark):
    seqs = spark.createDataFrame([("a", "A" * 37685, 37685), ("b", "C" * 6600, 6600), ("c", "G" * 16671, 16671), ("e", "", 0)], "seq_name string, seq string, length int")
    got = {}
    for r in sequences.split_fragments(seqs).collect():
        got.setdefault(r["seq_name"], []).append((r["start"], r["end"]))
        assert len(r["seq"]) == r["end"] - r["start"]
    assert sorted(got["a"]) == [(0, 9421), (9421, 18842), (18842, 28263), (28263, 37685)]
    assert got["b"] == [(0, 6600)] and sorted(got["c"]) == [(0, 8335), (8335, 16671)]
    literal = sequences.split_fragments(seqs.where("seq_name = 'a'"), integer_division=True)
    assert rows(literal, "start", "end") == [(0, 12561), (12561, 25123), (25123, 37685)]


def test_bins_and_positions(spark):
    dim = spark.createDataFrame([(k, n) for k, n in enumerate((4, 10, 14, 15, 25, 26))], "ix int, length int")
    got = {}
    for r in binning.extent_bins(dim, 10).sort("bin_id").collect():
        got.setdefault(r["ix"], []).append((r["left_edge"], r["right_edge"], r["center"]))
    assert [(a, b) for a, b, _ in got[3]] == [(0, 7), (7, 15)] and [c for *_, c in got[3]] == [-4, 3]
    assert [(a, b) for a, b, _ in got[4]] == [(0, 8), (8, 16), (16, 25)] and [c for *_, c in got[4]] == [-8.5, -0.5, 7.5]
    assert [c for *_, c in got[5]] == [-9, -1, 8] and len(got[0]) == len(got[1]) == len(got[2]) == 1
    x = spark.createDataFrame([(p,) for p in (0, 5, 6, 10, 15, 16)], "p int")
    assert [r[0] for r in x.select(binning.bin_of(F.col("p"), F.lit(15), F.lit(3))).collect()] == [0, 0, 1, 1, 2, 2]


def test_bin_of_equals_search(spark):
    rng = random.Random(5)
    data = []
    for _ in range(2000):
        length, n = rng.randint(1, 100_000), rng.randint(1, 200)
        data.append((rng.randint(0, length + 50), length, min(n, length)))
    df = spark.createDataFrame(data, "p int, length int, n int")
    for r in df.withColumn("b", binning.bin_of(F.col("p"), F.col("length"), F.col("n"))).collect():
        right = [r["length"] if k + 1 == r["n"] else math.floor((k + 1) * (float(r["length"]) / r["n"])) for k in range(r["n"])]
        assert r["b"] == next((k for k, e in enumerate(right) if e >= r["p"]), r["n"] - 1), r


def test_tip_goldens(spark):
    df = spark.createDataFrame([(100, 4), (100, 5), (100, 95), (100, 96), (8, 3), (8, 4), (8, 5)], "length int, p int")
    assert [r[0] for r in df.select(pairs.tip_side(F.col("p"), F.col("length"), 5)).collect()] == [0, None, None, 1, 0, None, 1]


def _loop_pairs(records, contigs, p):
    """Row by row, as the rules say."""
    out, counts = {}, dict.fromkeys(pairs.REASONS, 0)
    kept = [r for r in records if not r["flag"] & 0x904]
    k = 0
    while k + 1 < len(kept):
        a, b = kept[k], kept[k + 1]
        if a["qname"] != b["qname"]:
            k += 1
            continue
        k += 2
        if a["refid"] not in contigs or b["refid"] not in contigs:
            counts["ref_excluded"] += 1
            continue

        def good(r):
            if r["mapq"] < p.min_mapq:
                return False
            if p.strong:
                if not r["cigar"]:
                    return False
                op = r["cigar"][-1] if r["flag"] & 16 else r["cigar"][0]
                return op["op"] == 0 and op["len"] >= p.strong
            return True

        if not good(a) or not good(b):
            counts["poor_match"] += 1
            continue
        if a["flag"] & 128:
            a, b = b, a
        if p.min_insert and a["flag"] & 2 and b["pos"] - a["pos"] < p.min_insert:
            counts["short_insert"] += 1
            continue
        counts["accepted"] += 1
        i, j = sorted((contigs[a["refid"]], contigs[b["refid"]]))
        out[i, j] = out.get((i, j), 0) + 1
    return out, counts


def _random_records(seed, n=300):
    rng = random.Random(seed)
    records, k = [], 0
    for name in range(n):
        for _ in range(rng.randint(1, 4)):
            cigar = [{"op": rng.choice([0, 0, 4, 1, 2, 7]), "len": rng.randint(1, 60)} for _ in range(rng.randint(0, 3))]
            records.append({"rec_no": k, "qname": f"r{name:04}", "flag": sum(rng.choice([0, 0, 0, b]) for b in (4, 256, 2048)) + sum(rng.choice([0, b]) for b in (2, 16, 128)), "refid": rng.randint(0, 6), "pos": rng.randint(0, 900), "mapq": rng.randint(0, 80), "cigar": cigar})
            k += 1
    return records


@pytest.mark.parametrize("seed,params", [(1, MapParams(min_mapq=20, strong=10, min_insert=100)), (2, MapParams(min_mapq=30, strong=None)), (3, MapParams(min_mapq=5, strong=3))])
def test_pairs_equal_row_loop(spark, seed, params):
    records = _random_records(seed)
    dim = spark.createDataFrame([(r, r - 1, 1000) for r in range(1, 6)], "refid int, ix int, length int")
    al = spark.createDataFrame([Row(**r) for r in records], "rec_no bigint, qname string, flag int, refid int, pos int, mapq int, cigar array<struct<op:int,len:int>>")
    done = pairs.classify(pairs.mate_pairs(pairs.informative(al), params), dim, params)
    cells, counts = _loop_pairs(records, {r: r - 1 for r in range(1, 6)}, params)
    assert {(r["i"], r["j"]): r["w"] for r in contacts.count_contacts(done).collect()} == cells
    assert {r["reason"]: r["n_pairs"] for r in pairs.accounting(done).collect()} == counts


def test_symmetrize_and_signal(spark):
    up = spark.createDataFrame([(0, 0, 3), (0, 1, 4)], "i int, j int, w bigint")
    sym = contacts.symmetrize(up)
    assert rows(sym, "i", "j", "w") == [(0, 0, 3), (0, 1, 4), (1, 0, 4)]
    assert contacts.map_weight(sym).first()[0] == 11
    dim = spark.createDataFrame([(0, 5000), (1, 800), (2, 5000)], "ix int, length int")
    assert rows(contacts.max_offdiag(sym, dim), "ix", "sig") == [(0, 4), (1, 4), (2, 0)]
    assert rows(contacts.acceptance_mask(sym, dim, 1000, 2), "ix", "accepted") == [(0, True), (1, False), (2, False)]
    with pytest.raises(ValueError):
        contacts.acceptance_mask(sym, dim, 0, 2)
    assert contacts.is_hermitian(sym) and not contacts.is_hermitian(up)


def test_remap_gapless(spark):
    mask = spark.createDataFrame([(k, bool(x)) for k, x in enumerate((1, 0, 1, 1, 0, 1))], "ix int, accepted boolean")
    assert rows(contacts.gapless(mask), "dense_ix", "ix") == [(0, 0), (1, 2), (2, 3), (3, 5)]


def test_balance_golden(spark):
    m = spark.createDataFrame([(0, 1, 4.0), (1, 0, 4.0), (1, 1, 2.0), (1, 2, 1.0), (2, 1, 1.0)], "i int, j int, w double")
    dim = spark.createDataFrame([(0,), (1,), (2,)], "ix int")
    out, x, _ = normalise.balance(m, dim)
    assert [v for _, v in rows(x, "ix", "x")] == pytest.approx([0.605390, 0.261609, 0.877714], abs=2e-6)
    got = {(r["i"], r["j"]): round(r["w"], 6) for r in out.collect()}
    assert (got[0, 1], got[1, 1], got[1, 2]) == pytest.approx((0.633503, 0.136879, 0.229618), abs=2e-6) and (0, 0) not in got


@pytest.mark.parametrize("lengths,want", [((10, 5, 5), 5), ((5, 5), 5), ((8, 4, 3, 1), 4), ((2, 2, 2, 2), 2)])
def test_n50(spark, lengths, want):
    df = spark.createDataFrame([(0, k, n) for k, n in enumerate(lengths)], "cl_id int, ix int, length int")
    assert report.n50(df).first()["n50"] == want


def test_report_moments(spark):
    stats = spark.createDataFrame([(0, 0, 100, 40.0), (0, 1, 300, 60.0)], "cl_id int, ix int, length int, gc double")
    clusters = spark.createDataFrame([(0, "CL1")], "cl_id int, name string")
    r = report.cluster_report(stats, clusters).first()
    assert (r["gc_expect"], r["gc_mean"], r["gc_median"], r["gc_std"], r["extent"]) == (55, 50, 50, 10, 400)


def test_names_and_lines(spark):
    n = spark.createDataFrame([(k,) for k in (1, 9, 10, 11, 100, 101)], "n int")
    assert [r[0] for r in n.select(scalar.digits(F.col("n"))).collect()] == [1, 1, 1, 2, 2, 3]
    dim = spark.createDataFrame([(k, f"c{k}", 10) for k in range(4)], "ix int, name string, length int")
    members = spark.createDataFrame([(0, 1), (0, 3)], "cl_id int, ix int")
    assert [line for _, line in rows(report.membership_lines(members, dim), "line_no", "line")] == ["c1 c3", "c0", "c2"]
    moved, clusters = report.ranked(members, dim)
    assert rows(clusters, "cl_id", "name", "size", "extent") == [(0, "CL1", 2, 20)]
    with pytest.raises(NoRemainingClustersException):
        report.filtered(clusters, 21)


def test_downsample(spark):
    m = spark.createDataFrame([(i, j, float(3 * i + j)) for i in range(3) for j in range(3)], "i int, j int, w double")
    assert rows(heatmap.downsample(m, 2), "i", "j", "w") == [(0, 0, 2), (0, 1, 1.75), (1, 0, 3.25), (1, 1, 2)]
    assert rows(heatmap.downsample(m, 2, "max"), "i", "j", "w") == [(0, 0, 4), (0, 1, 5), (1, 0, 7), (1, 1, 8)]
    assert heatmap.reduction(8001) == 3 and heatmap.reduction(10) == 1


def test_tips(spark):
    up = spark.createDataFrame([(0, 1, 0, 1, 5), (1, 1, 0, 1, 2)], "i int, j int, k int, l int, w bigint")
    sym = tips.symmetrize_tips(up)
    assert rows(sym, "i", "j", "k", "l", "w") == [(0, 1, 0, 1, 5), (1, 0, 1, 0, 5), (1, 1, 0, 1, 2)]
    one = spark.createDataFrame([(1, 2, 0, 1, 1)], "i int, j int, k int, l int, w bigint")
    assert rows(tips.flatten(one), "i", "j") == [(2, 5)]


def test_sites(spark):
    df = spark.createDataFrame([("GATCGATC",), ("gatcNGATC",), ("AAGATTC",), ("",)], "seq string")
    count = [r[0] for r in df.select(sequences.site_count(F.col("seq"), [sequences.enzyme("DpnII")])).collect()]
    assert count == [1, 1, 0, 0]  # a cut before the first base is none
    hinf = [r[0] for r in df.select(sequences.site_count(F.col("seq"), [sequences.enzyme("HinfI")])).collect()]
    assert hinf == [0, 0, 1, 0]
    with pytest.raises(UnknownEnzymeException) as e:
        sequences.enzyme("dpnII")
    assert "DpnII" in e.value.similar
    assert df.select(scalar.reverse_complement(F.lit("ACGTNRYacgt"))).first()[0] == "acgtRYNACGT"
    assert [r[0] for r in df.select(scalar.gc_percent(F.col("seq"))).collect()][3] == 0


def test_orders(spark):
    dim = spark.createDataFrame([(k, 100 * (k + 1)) for k in range(4)], "ix int, length int")
    own = order.mask_one(order.initial(dim), 1)
    assert rows(order.accepted_positions(own), "rank", "ix") == [(0, 0), (1, 2), (2, 3)]
    given = spark.createDataFrame([(0, 3, 1), (1, 0, -1), (2, 2, 1)], "rank int, ix int, ori int")
    out = order.set_order(own, given)
    assert rows(order.accepted_positions(out), "rank", "ix", "ori") == [(0, 3, 1), (1, 0, -1), (2, 2, 1)]
    with pytest.raises(ValueError):
        order.set_order(own, given.where("rank < 2"))
    assert rows(order.set_order(own, given.where("rank < 2"), True).where("mask"), "ix") == [(0,), (3,)]
    p = spark.createDataFrame([(0, 3), (3, 0), (2, 3)], "a int, b int")
    assert rows(order.intervening(own, p), "a", "b", "between") == [(0, 3, 300), (2, 3, 0), (3, 0, 300)]
    m = spark.createDataFrame([(0, 2, 7), (2, 0, 7), (3, 3, 1)], "i int, j int, w int")
    assert rows(order.permute(m, order.accepted_positions(out)), "i", "j", "w") == [(0, 0, 1), (1, 2, 7), (2, 1, 7)]
    assert rows(order.double_order(given.where("rank = 1")), "rank", "ix") == [(2, 1), (3, 0)]


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "u int, v int")
    got = dict(rows(components.connected_components(e), "node", "component"))
    assert set(got.values()) == {0, 100} and got[60] == 0


def _planted(spark, blocks=6, size=12, seed=3):
    rng = random.Random(seed)
    edges = [(a, b, 1.0) for a, b in itertools.combinations(range(blocks * size), 2) if rng.random() < (0.6 if a // size == b // size else 0.02)]
    return spark.createDataFrame(edges, "u int, v int, weight double"), size


@pytest.mark.parametrize("method", ["louvain", "infomap", "mcl"])
def test_planted_communities(spark, method):
    edges, size = _planted(spark)
    found = clustering.mcl(edges, inflation=2.0) if method == "mcl" else clustering.cluster_graph(edges, method)
    got = {}
    for node, cl in rows(found, "node", "cl"):
        got.setdefault(cl, set()).add(node // size)
    assert len(got) == 6 and all(len(x) == 1 for x in got.values())


def test_unknown_names(spark):
    with pytest.raises(RuntimeError):
        scalar.mean_of("quadratic")
    with pytest.raises(RuntimeError):
        clustering.cluster_graph(None, "nothing")
    with pytest.raises(NotImplementedError):
        clustering.cluster_graph(None, "simap")


def test_soft_membership(spark):
    e = spark.createDataFrame([("a", "b", 5.0), ("b", "c", 1.0), ("c", "d", 5.0)], "u string, v string, weight double")
    part = spark.createDataFrame([("a", 0), ("b", 0), ("c", 1), ("d", 1)], "node string, cl int")
    assert rows(graph.soft_membership(e, part), "comm", "node", "strength") == [(0, "a", 1), (0, "b", 1), (0, "c", 0.5), (1, "b", 0.5), (1, "c", 1), (1, "d", 1)]
    assert len(rows(graph.soft_membership(e, part, "maxaff"), "comm")) == 4


def test_balancing_in_memory_brings_no_cells_to_the_driver(spark, monkeypatch):
    """Both ways give the same factors; neither collects the map."""
    cells = [(a, b, float(1 + (min(a, b) * 7 + max(a, b)) % 5)) for a in range(12) for b in range(12) if (a + b) % 3 or a == b]
    matrix, contigs = spark.createDataFrame(cells, "i int, j int, w double"), spark.createDataFrame([(k,) for k in range(14)], "ix int")
    for name in ("toArrow", "toPandas"):
        monkeypatch.setattr(type(matrix), name, lambda self, name=name: pytest.fail(f"{name} was called"))
    found = []
    for bound in (normalise.LOCAL_CELLS, 0):
        monkeypatch.setattr(normalise, "LOCAL_CELLS", bound)
        _, x, steps = normalise.balance(matrix, contigs, 1e-9)
        assert x.schema["ix"].dataType == contigs.schema["ix"].dataType
        found.append((x.groupBy().agg(F.count("*"), F.round(F.sum("x"), 9), F.round(F.sum(F.col("x") * F.col("ix")), 8)).first(), steps))
    assert found[0] == found[1]
    assert found[0][0][0] == 14
    with pytest.raises(RuntimeError, match="didn't reach"):
        monkeypatch.setattr(normalise, "LOCAL_CELLS", 100_000)
        normalise.balance(matrix, contigs, 1e-9, max_iter=1)


@pytest.mark.parametrize("bound", [normalise.LOCAL_CELLS, 0])
def test_nearly_bipartite_map_is_balanced(spark, monkeypatch, bound):
    """A heavy contact of contigs whose diagonals are light and differ: damped steps alone need more than 500."""
    monkeypatch.setattr(normalise, "LOCAL_CELLS", bound)
    monkeypatch.setattr(normalise, "DAMPED", 5, raising=False)
    rows = [(0, 0, 5.0), (0, 1, 300.0), (1, 0, 300.0), (1, 2, 2.0), (2, 1, 2.0)]
    matrix, contigs = spark.createDataFrame(rows, "i int, j int, w double").repartition(2), spark.range(3).select(F.col("id").cast("int").alias("ix"))
    plain = np.eye(3)
    for i, j, w in rows:
        plain[i, j] = w
    x = 1 / np.sqrt(plain.sum(axis=1))
    for _ in range(500):
        x = np.sqrt(x / (plain @ x))
    assert ((1 - x * (plain @ x)) ** 2).sum() > 1e-24
    _, scale, _ = normalise.balance(matrix, contigs, 1e-12, max_iter=500)
    found = np.array([r["x"] for r in sorted(scale.collect())])
    assert np.abs(found * (plain @ found) - 1).max() < 1e-11
