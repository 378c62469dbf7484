"""The likelihood of an order against brute force."""

import math
import random

import pytest

from pairloom.operators import likelihood
from pairloom.plans import catalogue

SF = "/root/testdata/sf0.01"


def brute_likelihood(extent, bins, order, total, zero_counts=True):
    """The published sum over every pair of bins of two accepted contigs."""
    ahead, own = 0, {}
    for ix, length, ori in order:
        own[ix] = (ahead, length, ori)
        ahead += length
    seen = {(b1, b2): w for b1, b2, w in extent}
    out = 0.0
    for a, p, c1 in bins:
        for b, q, c2 in bins:
            if not (a < b and a in own and b in own):
                continue
            (s1, l1, o1), (s2, l2, o2) = own[a], own[b]
            between = s2 - s1 - l1 if s1 < s2 else s1 - s2 - l2
            s = abs(between + 0.5 * (l1 + l2) + o1 * c2 - o2 * c1)
            e = total * (0.122123774414444 / 13.675170758388262 * (1 + (s - 13.973247315647466) / 13.675170758388262) ** (-1.122123774414444) if s < 500_000 else 2e-8)
            w = seen.get((min(p, q), max(p, q)), 0)
            out += w * math.log(w / e) + e - w + 0.5 * math.log(2 * math.pi * w) if w else e * zero_counts
    return -out


def collected(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_order_likelihood_counts_all_contigs(spark):
    dim = sorted(collected(catalogue.contigs(spark, SF), "ix", "length"))
    assert len(dim) > 30
    bins, extent = collected(catalogue.bins(spark, SF), "ix", "bin_id", "center"), collected(catalogue.extent(spark, SF), "b1", "b2", "w")
    want = brute_likelihood(extent, bins, [(ix, n, 1) for ix, n in dim], 1000.0)
    got = catalogue.order_likelihood(spark, SF).head()["loglik"]
    assert got == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("zero_counts", [True, False])
def test_likelihood_of_a_turned_order(spark, zero_counts):
    rng = random.Random(5)
    lengths = [rng.choice((1500, 30_000, 700_000)) for _ in range(25)]
    dim = spark.createDataFrame(list(enumerate(lengths)), "ix int, length int")
    pos = rng.sample(range(25), 25)
    full = [(k, pos[k], rng.choice((1, -1)), k % 6 != 1, n) for k, n in enumerate(lengths)]
    order = spark.createDataFrame(full, "ix int, pos int, ori tinyint, mask boolean, length int")
    bins = catalogue.binning.extent_bins(dim, 50_000)
    own = collected(bins, "ix", "bin_id", "center")
    cells = {tuple(sorted(rng.choices(range(len(own)), k=2))): rng.randint(1, 9) for _ in range(300)}
    extent = [(a, b, w) for (a, b), w in cells.items()]
    want = brute_likelihood(extent, own, [(k, n, o) for k, p, o, m, n in sorted(full, key=lambda r: r[1]) if m], 50.0, zero_counts)
    got = likelihood.log_likelihood(spark.createDataFrame(extent, "b1 int, b2 int, w bigint"), bins, order, 50.0, zero_counts).head()["loglik"]
    assert got == pytest.approx(want, rel=1e-9)
