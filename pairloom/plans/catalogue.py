"""Registered queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions import scalar
from pairloom.operators import binning, clustering, components, contacts, graph, heatmap, likelihood, normalise, order, pairs, report, sequences, tips
from pairloom.params import MapParams
from pairloom.plans import adapters
from pairloom.plans.contact_map import ContactMap

PARAMS = MapParams(min_mapq=20, strong=10, min_insert=100, min_len=1000, min_sig=3, bin_size=10_000)
TIP_PARAMS = MapParams(min_mapq=20, strong=10, min_insert=100, min_len=1000, min_sig=3, tip_size=5000)
BIN = PARAMS.bin_size

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


# ---------------------------------------------------------------- SQL that several queries share

BASE = f"""
refs AS ({adapters.REFS}),
contigs AS (SELECT CAST(row_number() OVER (ORDER BY refid) - 1 AS INT) AS ix,
  CAST(coalesce(sum(length) OVER (ORDER BY refid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", refid, name, length, sites FROM refs WHERE length >= 1000),
al AS ({adapters.ALIGNMENTS}),
inf AS (SELECT *, (flag & 16) <> 0 AS rev, (flag & 128) <> 0 AS read2, (flag & 2) <> 0 AS proper, len2 + CASE WHEN op1 = 0 THEN len1 ELSE 0 END AS alen,
  pos + CASE WHEN (flag & 16) <> 0 THEN len2 + CASE WHEN op1 = 0 THEN len1 ELSE 0 END ELSE 0 END AS pos5,
  mapq >= 20 AND CASE WHEN (flag & 16) <> 0 THEN op2 = 0 AND len2 >= 10 ELSE op1 = 0 AND len1 >= 10 END AS good FROM al WHERE (flag & 2308) = 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY qname ORDER BY rec_no) AS n FROM inf),
mates AS (SELECT a.qname, a.rec_no, a.read2 AS swap,
  a.refid AS ar, a.pos AS ap, a.pos5 AS a5, a.good AS ag, a.proper AS app, a.mapq AS am, b.refid AS br, b.pos AS bp, b.pos5 AS b5, b.good AS bg, b.proper AS bpp, b.mapq AS bm
  FROM numbered a JOIN numbered b ON a.qname = b.qname AND b.n = a.n + 1 WHERE a.n % 2 = 1),
prs AS (SELECT qname, rec_no, CASE WHEN swap THEN br ELSE ar END AS r1, CASE WHEN swap THEN bp ELSE ap END AS p1, CASE WHEN swap THEN b5 ELSE a5 END AS x1, CASE WHEN swap THEN bpp ELSE app END AS proper1,
  CASE WHEN swap THEN ar ELSE br END AS r2, CASE WHEN swap THEN ap ELSE bp END AS p2, CASE WHEN swap THEN a5 ELSE b5 END AS x2, ag AND bg AS good, am, bm FROM mates),
cls0 AS (SELECT qname, prs.rec_no, CASE WHEN d2.ix < d1.ix THEN d2.ix ELSE d1.ix END AS i, CASE WHEN d2.ix < d1.ix THEN d1.ix ELSE d2.ix END AS j,
  CASE WHEN d2.ix < d1.ix THEN x2 ELSE x1 END AS p_i, CASE WHEN d2.ix < d1.ix THEN x1 ELSE x2 END AS p_j,
  CASE WHEN d2.ix < d1.ix THEN d2.length ELSE d1.length END AS len_i, CASE WHEN d2.ix < d1.ix THEN d1.length ELSE d2.length END AS len_j,
  CASE WHEN d1.ix IS NULL OR d2.ix IS NULL THEN 'ref_excluded' WHEN NOT good THEN 'poor_match' WHEN proper1 AND p2 - p1 < 100 THEN 'short_insert' ELSE 'accepted' END AS reason
  FROM prs LEFT JOIN contigs d1 ON r1 = d1.refid LEFT JOIN contigs d2 ON r2 = d2.refid),
up AS (SELECT i, j, count(*) AS w FROM cls0 WHERE reason = 'accepted' GROUP BY i, j),
sym AS (SELECT i, j, w FROM up UNION ALL SELECT j, i, w FROM up WHERE i <> j),
sig AS (SELECT ix, length, coalesce(max(w), 0) AS sig FROM contigs LEFT JOIN sym ON j = ix AND i <> j GROUP BY ix, length),
mask AS (SELECT ix, length, sig, length >= 1000 AND sig >= 3 AS accepted FROM sig),
dense AS (SELECT CAST(row_number() OVER (ORDER BY ix) - 1 AS INT) AS dense_ix, ix FROM mask WHERE accepted),
norm AS (SELECT i, j, w / CAST(greatest(a.sites, 1) * greatest(b.sites, 1) AS DOUBLE) AS w FROM sym JOIN contigs a ON i = a.ix JOIN contigs b ON j = b.ix),
edges AS (SELECT i AS u, j AS v, CAST(w AS DOUBLE) AS weight FROM up),
both_ways AS (SELECT u, v, weight FROM edges UNION ALL SELECT v, u, weight FROM edges WHERE u <> v),
part AS (SELECT ix AS node, ix % 10 AS cl FROM contigs),
members AS (SELECT refid % 10 AS cl_id, ix FROM contigs)
"""

_N = "greatest(length // 10000, 1) + CASE WHEN length % 10000 <> 0 AND CAST(length AS DOUBLE) / 10000 - greatest(length // 10000, 1) >= 0.5 THEN 1 ELSE 0 END"
_EDGE = "CAST(CASE WHEN ({k}) = n THEN length ELSE floor(({k}) * (CAST(length AS DOUBLE) / n)) END AS INT)"
BINS = f"""
nb AS (SELECT ix, length, CAST({_N} AS INT) AS n FROM contigs),
fb AS (SELECT *, coalesce(sum(n) OVER (ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_bin FROM nb),
bins AS (SELECT ix, CAST(first_bin + k AS INT) AS bin_id, CAST(k AS INT) AS bin_no, {_EDGE.format(k="k")} AS left_edge, {_EDGE.format(k="k + 1")} AS right_edge,
  {_EDGE.format(k="k")} + CAST(0.5 AS DOUBLE) * {_EDGE.format(k="1")} - CAST(0.5 AS DOUBLE) * length AS center FROM (SELECT *, unnest(range(n)) AS k FROM fb)),
hit AS (SELECT qname, rec_no, (SELECT coalesce(min(bin_id), max(m)) FROM (SELECT bin_id, NULL AS m FROM bins WHERE ix = i AND right_edge >= p_i UNION ALL SELECT NULL, max(bin_id) FROM bins WHERE ix = i)) AS x,
  (SELECT coalesce(min(bin_id), max(m)) FROM (SELECT bin_id, NULL AS m FROM bins WHERE ix = j AND right_edge >= p_j UNION ALL SELECT NULL, max(bin_id) FROM bins WHERE ix = j)) AS y FROM cls0 WHERE reason = 'accepted'),
ext AS (SELECT least(x, y) AS b1, greatest(x, y) AS b2, count(*) AS w FROM hit GROUP BY 1, 2),
esym AS (SELECT b1, b2, w FROM ext UNION ALL SELECT b2, b1, w FROM ext WHERE b1 <> b2)
"""
_SIDE = "CASE WHEN {l} > 10000 THEN CASE WHEN {p} < 5000 THEN 0 WHEN {p} > {l} - 5000 THEN 1 END ELSE CASE WHEN {p} < {l} - {p} THEN 0 WHEN {l} - {p} < {p} THEN 1 END END"
TIPS = f"""
sides AS (SELECT *, {_SIDE.format(p="p_i", l="len_i")} AS k, {_SIDE.format(p="p_j", l="len_j")} AS l FROM cls0),
tup AS (SELECT i, j, k, l, count(*) AS w FROM sides WHERE reason = 'accepted' AND k IS NOT NULL AND l IS NOT NULL GROUP BY i, j, k, l),
tsym AS (SELECT i, j, k, l, CAST(sum(w) AS BIGINT) AS w FROM (SELECT i, j, k, l, w FROM tup UNION ALL SELECT j, i, l, k, w FROM tup WHERE i <> j) GROUP BY i, j, k, l)
"""
ORD = """
ordering AS (SELECT CAST(row_number() OVER (ORDER BY length DESC, ix) - 1 AS INT) AS rank, ix, CASE WHEN ix % 3 = 0 THEN -1 ELSE 1 END AS ori FROM mask WHERE accepted)
"""
SEQS = f"""
seqs AS (SELECT seq_name, seq, CAST(length(seq) AS INT) AS length, ix FROM ({adapters.SEQUENCES}))
"""


def sql(select: str, *more: str) -> str:
    return "WITH " + ",".join([BASE, *more]) + select


def seq_sql(select: str, *more: str) -> str:
    return "WITH " + ",".join([SEQS, *more]) + select


# ---------------------------------------------------------------- plans that several queries share


def contigs(spark: SparkSession, sf: str) -> DataFrame:
    return contacts.contig_dimension(adapters.refs(spark, sf), min_len=PARAMS.min_len)


def classified(spark: SparkSession, sf: str, params: MapParams = PARAMS) -> DataFrame:
    kept = pairs.informative(adapters.alignments(spark, sf))
    return pairs.classify(pairs.mate_pairs(kept, params), contigs(spark, sf), params)


def upper(spark: SparkSession, sf: str) -> DataFrame:
    return contacts.count_contacts(classified(spark, sf))


def symmetric(spark: SparkSession, sf: str) -> DataFrame:
    return contacts.symmetrize(upper(spark, sf))


def mask(spark: SparkSession, sf: str) -> DataFrame:
    return contacts.acceptance_mask(symmetric(spark, sf), contigs(spark, sf), PARAMS.min_len, PARAMS.min_sig)


def ordering(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    rank = (F.row_number().over(Window.orderBy(F.desc("length"), "ix")) - 1).cast("int").alias("rank")
    return mask(spark, sf).where("accepted").select(rank, "ix", F.when(F.col("ix") % 3 == 0, -1).otherwise(1).alias("ori"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    return upper(spark, sf).select(F.col("i").alias("u"), F.col("j").alias("v"), F.col("w").cast("double").alias("weight"))


def partition(spark: SparkSession, sf: str) -> DataFrame:
    return contigs(spark, sf).select(F.col("ix").alias("node"), (F.col("ix") % 10).alias("cl"))


def members(spark: SparkSession, sf: str) -> DataFrame:
    return contigs(spark, sf).select((F.col("refid") % 10).alias("cl_id"), "ix")


def bins(spark: SparkSession, sf: str) -> DataFrame:
    return binning.extent_bins(contigs(spark, sf), BIN)


def extent(spark: SparkSession, sf: str) -> DataFrame:
    return binning.extent_map(classified(spark, sf), contigs(spark, sf), BIN)


def tip_upper(spark: SparkSession, sf: str) -> DataFrame:
    return tips.count_tips(classified(spark, sf, TIP_PARAMS))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else F.col(c) for c in df.columns])


# ---------------------------------------------------------------- pairs and contact maps


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    up = upper(spark, sf)
    signal = contacts.max_offdiag(contacts.symmetrize(up), contigs(spark, sf)).withColumnRenamed("ix", "i")
    return up.join(signal, "i").select("i", "j", "w", "sig")


@query(sql("SELECT up.i, up.j, up.w, CAST(sig AS BIGINT) AS sig FROM up JOIN sig ON up.i = sig.ix"))
def contact_signal(spark, sf):
    return flagship(spark, sf)


@query(sql("SELECT qname, rec_no, refid, rev AS reverse, CAST(alen AS INT) AS alen, CAST(pos5 AS INT) AS pos5 FROM inf"))
def informative_alignments(spark, sf):
    return pairs.informative(adapters.alignments(spark, sf)).select("qname", "rec_no", "refid", "reverse", "alen", "pos5")


@query(sql("SELECT r.reason, CAST(count(c.reason) AS BIGINT) AS n_pairs FROM (SELECT unnest(['accepted','not_tip','short_insert','ref_excluded','poor_match','median_excluded','end_buffered']) AS reason) r LEFT JOIN cls0 c ON r.reason = c.reason GROUP BY r.reason"))
def pair_accounting(spark, sf):
    return pairs.accounting(classified(spark, sf))


@query(sql("SELECT r.reason, CAST(count(c.reason) AS BIGINT) AS n_pairs FROM (SELECT unnest(['accepted','not_tip','short_insert','ref_excluded','poor_match','median_excluded','end_buffered']) AS reason) r LEFT JOIN (SELECT CASE WHEN reason = 'accepted' AND (k IS NULL OR l IS NULL) THEN 'not_tip' ELSE reason END AS reason FROM sides) c ON r.reason = c.reason GROUP BY r.reason", TIPS))
def pair_accounting_tips(spark, sf):
    return pairs.accounting(classified(spark, sf, TIP_PARAMS))


@query(sql("SELECT qname, rec_no, least(r1, r2) AS lo, greatest(r1, r2) AS hi FROM prs WHERE am >= 20 AND bm >= 20"))
def simple_match_pairs(spark, sf):
    p = MapParams(min_mapq=20, strong=None)
    out = pairs.mate_pairs(pairs.informative(adapters.alignments(spark, sf)), p).where("r1.good AND r2.good")
    return out.select("qname", "rec_no", F.least("r1.refid", "r2.refid").alias("lo"), F.greatest("r1.refid", "r2.refid").alias("hi"))


@query(sql("SELECT qname, rec_no, least(r1, r2) AS lo, greatest(r1, r2) AS hi FROM prs WHERE good"))
def strong_match_pairs(spark, sf):
    out = pairs.mate_pairs(pairs.informative(adapters.alignments(spark, sf)), PARAMS).where("r1.good AND r2.good")
    return out.select("qname", "rec_no", F.least("r1.refid", "r2.refid").alias("lo"), F.greatest("r1.refid", "r2.refid").alias("hi"))


@query(sql("SELECT i, j, w FROM up"))
def contact_map_upper(spark, sf):
    return upper(spark, sf)


@query(sql("SELECT i, j, w FROM sym"))
def contact_map_symmetric(spark, sf):
    return symmetric(spark, sf)


@query(sql("SELECT CAST(coalesce(sum(w), 0) AS BIGINT) AS weight FROM sym"))
def map_weight(spark, sf):
    return contacts.map_weight(symmetric(spark, sf))


@query(sql("SELECT ix, CAST(sig AS BIGINT) AS sig FROM sig"))
def max_offdiag_signal(spark, sf):
    return contacts.max_offdiag(symmetric(spark, sf), contigs(spark, sf))


@query(sql("SELECT ix, length, CAST(sig AS BIGINT) AS sig, accepted FROM mask"))
def acceptance_mask(spark, sf):
    return mask(spark, sf)


@query(sql("SELECT CAST(count_if(accepted) AS BIGINT) AS n_accepted, CAST(count_if(NOT accepted) AS BIGINT) AS n_excluded FROM mask"))
def mask_counts(spark, sf):
    return contacts.mask_counts(mask(spark, sf))


@query(sql('SELECT ix, "offset", refid, name, length, sites FROM contigs'))
def contig_dimension(spark, sf):
    return contigs(spark, sf)


@query(sql("SELECT dense_ix, ix FROM dense"))
def remap_gapless(spark, sf):
    return contacts.gapless(mask(spark, sf))


@query(sql("SELECT a.dense_ix AS i, b.dense_ix AS j, w FROM sym JOIN dense a ON i = a.ix JOIN dense b ON j = b.ix"))
def compressed_map(spark, sf):
    return contacts.compress(symmetric(spark, sf), mask(spark, sf))


@query(sql("SELECT a.dense_ix AS i, b.dense_ix AS j, w FROM sym JOIN (SELECT CAST(row_number() OVER (ORDER BY ix) - 1 AS INT) AS dense_ix, ix FROM mask WHERE accepted AND ix % 4 <> 1) a ON i = a.ix JOIN (SELECT CAST(row_number() OVER (ORDER BY ix) - 1 AS INT) AS dense_ix, ix FROM mask WHERE accepted AND ix % 4 <> 1) b ON j = b.ix"))
def externally_masked_map(spark, sf):
    external = contigs(spark, sf).select("ix", (F.col("ix") % 4 != 1).alias("keep"))
    return contacts.compress(symmetric(spark, sf), contacts.with_external_mask(mask(spark, sf), external))


@query(sql("SELECT CAST(count_if(abs(coalesce(a.w, 0) - coalesce(b.w, 0)) >= 1e-6) AS BIGINT) AS n_violations FROM sym a FULL JOIN sym b ON a.i = b.j AND a.j = b.i"))
def hermitian_check(spark, sf):
    return contacts.hermitian_violations(symmetric(spark, sf))


@query(sql("SELECT CAST(count_if(abs(coalesce(a.w, 0) - coalesce(b.w, 0)) >= 1e-6) AS BIGINT) AS n_violations FROM up a FULL JOIN up b ON a.i = b.j AND a.j = b.i"))
def hermitian_check_upper(spark, sf):
    return contacts.hermitian_violations(upper(spark, sf))


# ---------------------------------------------------------------- bins


@query(sql("SELECT ix, bin_id, bin_no, left_edge, right_edge, center FROM bins", BINS))
def extent_bins(spark, sf):
    return bins(spark, sf)


@query(sql("SELECT b1, b2, w FROM ext", BINS))
def extent_map(spark, sf):
    return extent(spark, sf)


@query(sql("SELECT a.ix AS i, b.ix AS j, CAST(sum(w) AS BIGINT) AS w FROM ext JOIN bins a ON b1 = a.bin_id JOIN bins b ON b2 = b.bin_id GROUP BY 1, 2", BINS))
def extent_to_seq_rollup(spark, sf):
    return binning.extent_to_seq(extent(spark, sf), bins(spark, sf))


def _extent_norm(name: str, expression: str) -> None:
    @query(sql(f"SELECT b1, b2, round(w / (1e-3 * {expression}), 6) AS w FROM (SELECT b1, b2, w, CAST(ca.length AS DOUBLE) AS x, CAST(cb.length AS DOUBLE) AS y FROM esym JOIN bins a ON b1 = a.bin_id JOIN bins b ON b2 = b.bin_id JOIN contigs ca ON a.ix = ca.ix JOIN contigs cb ON b.ix = cb.ix)", BINS))
    def run(spark, sf):
        return rounded(binning.normalise_extent(binning.symmetric_bins(extent(spark, sf)), bins(spark, sf), contigs(spark, sf), name), "w")

    for table in (QUERIES, ORACLES):
        table[f"extent_norm_{name}"] = table.pop("run")


_extent_norm("geometric", "sqrt(x * y)")
_extent_norm("harmonic", "(2.0 * x * y / (x + y))")
_extent_norm("arithmetic", "(0.5 * (x + y))")

_DENSE_BINS = "db AS (SELECT bin_id, CAST(row_number() OVER (ORDER BY bin_id) - 1 AS INT) AS d FROM bins JOIN mask ON bins.ix = mask.ix WHERE accepted)"


@query(sql("SELECT a.d AS b1, b.d AS b2, w FROM esym JOIN db a ON b1 = a.bin_id JOIN db b ON b2 = b.bin_id", BINS, _DENSE_BINS))
def extent_compressed(spark, sf):
    return binning.compress_extent(binning.symmetric_bins(extent(spark, sf)), bins(spark, sf), mask(spark, sf))


_MOVED = """
sz AS (SELECT ordering.ix, ori, rank, n, coalesce(sum(n) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ordering JOIN nb ON ordering.ix = nb.ix),
mv AS (SELECT bin_id, CAST(start + CASE WHEN ori > 0 THEN bin_no ELSE n - 1 - bin_no END AS INT) AS d FROM bins JOIN sz ON bins.ix = sz.ix)
"""


@query(sql("SELECT a.d AS b1, b.d AS b2, w FROM esym JOIN mv a ON b1 = a.bin_id JOIN mv b ON b2 = b.bin_id", BINS, ORD, _MOVED))
def extent_permuted(spark, sf):
    return binning.permute_extent(binning.symmetric_bins(extent(spark, sf)), bins(spark, sf), ordering(spark, sf))


# ---------------------------------------------------------------- ends


@query(sql("SELECT i, j, CAST(k AS INT) AS k, CAST(l AS INT) AS l, w FROM tsym", TIPS))
def tip_map(spark, sf):
    return tips.symmetrize_tips(tip_upper(spark, sf))


@query(sql("SELECT i, j, CAST(sum(w) AS BIGINT) AS w FROM tsym GROUP BY i, j", TIPS))
def tip_marginal(spark, sf):
    return tips.marginal(tips.symmetrize_tips(tip_upper(spark, sf)))


@query(sql("SELECT CAST(2 * i + k AS INT) AS i, CAST(2 * j + l AS INT) AS j, w FROM tsym", TIPS))
def tip_flattened(spark, sf):
    return tips.flatten(tips.symmetrize_tips(tip_upper(spark, sf)))


@query(sql("SELECT ix, CAST(coalesce(max(s.w), 0) AS BIGINT) AS sig FROM contigs LEFT JOIN (SELECT i, j, sum(w) AS w FROM tsym WHERE i <> j GROUP BY i, j) s ON s.j = ix GROUP BY ix", TIPS))
def tip_signal(spark, sf):
    return tips.tip_signal(tips.symmetrize_tips(tip_upper(spark, sf)), contigs(spark, sf))


@query(sql("SELECT a.dense_ix AS i, b.dense_ix AS j, CAST(k AS INT) AS k, CAST(l AS INT) AS l, w FROM tsym JOIN dense a ON i = a.ix JOIN dense b ON j = b.ix", TIPS))
def tip_compressed(spark, sf):
    return contacts.compress(tips.symmetrize_tips(tip_upper(spark, sf)), mask(spark, sf))


@query(sql("SELECT i, j, CAST(k AS INT) AS k, CAST(l AS INT) AS l, round(w * (25000000.0 / (CAST(least(5000, a.length) AS DOUBLE) * least(5000, b.length))), 6) AS w FROM tsym JOIN contigs a ON i = a.ix JOIN contigs b ON j = b.ix", TIPS))
def tip_norm_by_length(spark, sf):
    return rounded(tips.normalise_by_length(tips.symmetrize_tips(tip_upper(spark, sf)), contigs(spark, sf), 5000), "w")


@query(sql("SELECT i, j, CAST(k AS INT) AS k, CAST(l AS INT) AS l, round(w / CAST(greatest(CASE WHEN k = 0 THEN a.sites ELSE (a.sites * 5) % 7 END, 1) * greatest(CASE WHEN l = 0 THEN b.sites ELSE (b.sites * 5) % 7 END, 1) AS DOUBLE), 6) AS w FROM tsym JOIN contigs a ON i = a.ix JOIN contigs b ON j = b.ix", TIPS))
def tip_norm_by_site(spark, sf):
    dim = contigs(spark, sf).select("ix", F.array(F.col("sites"), F.col("sites") * 5 % 7).alias("sites"))
    return rounded(tips.normalise_by_site(tips.symmetrize_tips(tip_upper(spark, sf)), dim), "w")


# ---------------------------------------------------------------- normalisation, balancing, order


@query(sql("SELECT i, j, round(w, 6) AS w FROM norm"))
def site_normalised_map(spark, sf):
    return rounded(normalise.by_sites(symmetric(spark, sf), contigs(spark, sf)), "w")


@query(sql("SELECT i, j, round(w / (1e-3 * sqrt(CAST(a.length AS DOUBLE) * b.length)), 6) AS w FROM sym JOIN contigs a ON i = a.ix JOIN contigs b ON j = b.ix"))
def length_normalised_map(spark, sf):
    return rounded(normalise.by_length(symmetric(spark, sf), contigs(spark, sf)), "w")


def _balance_sql(steps: int) -> str:
    out = """work AS (SELECT i, j, w FROM norm WHERE i <> j UNION ALL SELECT ix, ix, coalesce(n.w, 1.0) FROM contigs LEFT JOIN norm n ON n.i = ix AND n.j = ix AND n.w <> 0),
x0 AS (SELECT i AS ix, 1 / sqrt(sum(w)) AS x FROM work GROUP BY i)"""
    for k in range(steps):
        out += f",\ny{k} AS (SELECT i AS ix, sum(w * x) AS y FROM work JOIN x{k} ON j = ix GROUP BY i),\nx{k + 1} AS (SELECT x{k}.ix, sqrt(x / y) AS x FROM x{k} JOIN y{k} ON x{k}.ix = y{k}.ix)"
    return out


@query(sql("SELECT norm.i, norm.j, round(norm.w * a.x * b.x, 6) AS w FROM norm JOIN x5 a ON norm.i = a.ix JOIN x5 b ON norm.j = b.ix", _balance_sql(5)))
def balanced_map_iter5(spark, sf):
    from pairloom.session import materialise

    m = materialise(normalise.by_sites(symmetric(spark, sf), contigs(spark, sf)))
    work = normalise.working_copy(m, contigs(spark, sf))
    x = normalise.start_vector(work)
    for _ in range(5):
        x = materialise(normalise.balance_step(work, x))
    return rounded(normalise.scaled(m, x), "w")


def _converged(name: str, cells: str, ids: str, steps: int = 150) -> str:
    """The factors f (ix, x) of the symmetric cells (i, j, w) after many steps, each worked out once."""
    out = f"""{name}_w AS MATERIALIZED (SELECT i, j, CAST(w AS DOUBLE) AS w FROM {cells} WHERE i <> j UNION ALL SELECT ix, ix, coalesce(n.w, 1.0) FROM {ids} LEFT JOIN {cells} n ON n.i = ix AND n.j = ix AND n.w <> 0),
{name}_0 AS MATERIALIZED (SELECT i AS ix, 1 / sqrt(sum(w)) AS x FROM {name}_w GROUP BY i)"""
    for k in range(steps):
        out += f""",
{name}_{k + 1} AS MATERIALIZED (SELECT x.ix, sqrt(x.x / y.y) AS x FROM {name}_{k} x JOIN (SELECT i, sum(w * x) AS y FROM {name}_w JOIN {name}_{k} ON j = ix GROUP BY i) y ON x.ix = y.i)"""
    return out + f",\n{name} AS (SELECT ix, x FROM {name}_{steps})"


#: Balanced as far as numbers go, so that rounded results don't depend on where an engine stops.
_END = 1e-12
_FACTORS = _converged("f", "norm", "contigs")


@query(sql("SELECT f.ix, round(x * y, 5) AS row_sum FROM f JOIN (SELECT i, sum(w * x) AS y FROM f_w JOIN f ON j = ix GROUP BY i) s ON f.ix = s.i", _FACTORS))
def balanced_residual(spark, sf):
    """Balances to the usual tolerance; the row sums of the result."""
    from pairloom.session import materialise

    m = materialise(normalise.by_sites(symmetric(spark, sf), contigs(spark, sf)))
    _, x, _ = normalise.balance(m, contigs(spark, sf))
    sums = normalise.times(normalise.working_copy(m, contigs(spark, sf)), x)
    return x.join(sums, "ix").select("ix", F.round(F.col("x") * F.col("y"), 5).alias("row_sum"))


@query(sql("SELECT ix, round(x, 6) AS x FROM f", _FACTORS))
def balance_factors(spark, sf):
    from pairloom.session import materialise

    m = materialise(normalise.by_sites(symmetric(spark, sf), contigs(spark, sf)))
    return rounded(normalise.balance(m, contigs(spark, sf), _END)[1], "x")


def contact_map(spark: SparkSession, sf: str, params: MapParams = PARAMS) -> ContactMap:
    """The driver's tables as a map with all its parts."""
    dim = contigs(spark, sf)
    tip = tips.symmetrize_tips(tip_upper(spark, sf)) if params.tip_size else None
    if params.tip_size:
        dim = dim.withColumn("sites", F.array(F.col("sites"), F.col("sites") * 5 % 7))
    seq = tips.marginal(tip) if params.tip_size else symmetric(spark, sf)
    return ContactMap(dim, seq, pairs.accounting(classified(spark, sf, params)), params, tip, extent(spark, sf) if params.bin_size else None)


@query(sql("SELECT norm.i, norm.j, round(norm.w * a.x * b.x, 6) AS w FROM norm JOIN f a ON norm.i = a.ix JOIN f b ON norm.j = b.ix", _FACTORS))
def processed_map(spark, sf):
    return rounded(contact_map(spark, sf).processed(tol=_END), "w")


@query(sql("SELECT a.dense_ix AS i, b.dense_ix AS j, round(norm.w * x.x * y.x, 6) AS w FROM norm JOIN f x ON norm.i = x.ix JOIN f y ON norm.j = y.ix JOIN dense a ON norm.i = a.ix JOIN dense b ON norm.j = b.ix", _FACTORS))
def processed_subspace(spark, sf):
    m = contact_map(spark, sf)
    return rounded(m.subspace(m.processed(tol=_END)), "w")


_PROCESSED = _FACTORS + """,
inner_map AS (SELECT norm.i, norm.j, norm.w * x.x * y.x AS w FROM norm JOIN f x ON norm.i = x.ix JOIN f y ON norm.j = y.ix WHERE norm.i IN (SELECT ix FROM dense) AND norm.j IN (SELECT ix FROM dense))"""


@query(sql("SELECT i AS u, j AS v, round(w / (SELECT max(w) FROM inner_map), 6) AS weight FROM inner_map WHERE i <= j AND w > 0", _PROCESSED))
def processed_edges(spark, sf):
    """The graph that is clustered: normalised, balanced, without masked contigs, scaled."""
    return rounded(contact_map(spark, sf).edges(tol=_END), "weight")


@query(sql("SELECT i, j, round(w, 6) AS w FROM ln", "ln AS (SELECT i, j, w / (1e-3 * (2.0 / (1.0 / CAST(a.length AS DOUBLE) + 1.0 / b.length))) AS w FROM sym JOIN contigs a ON i = a.ix JOIN contigs b ON j = b.ix)"))
def processed_by_harmonic_length(spark, sf):
    return rounded(contact_map(spark, sf).processed(bisto=False, by="length", mean="harmonic"), "w")


_TIP_NORM = """
tn AS (SELECT i, j, k, l, w / CAST(greatest(CASE WHEN k = 0 THEN a.sites ELSE (a.sites * 5) % 7 END, 1) * greatest(CASE WHEN l = 0 THEN b.sites ELSE (b.sites * 5) % 7 END, 1) AS DOUBLE) AS w FROM tsym JOIN contigs a ON i = a.ix JOIN contigs b ON j = b.ix),
tm AS (SELECT i, j, sum(w) AS w FROM tn GROUP BY i, j)"""


@query(sql("SELECT i, j, round(w * x.x * y.x, 6) AS w FROM tm JOIN f x ON i = x.ix JOIN f y ON j = y.ix", TIPS, _TIP_NORM, _converged("f", "tm", "contigs")))
def tip_processed_map(spark, sf):
    """Ends normalised by their sites, balanced by contigs, and marginalised."""
    return rounded(contact_map(spark, sf, TIP_PARAMS).processed(tol=_END), "w")


@query(sql("SELECT CAST(2 * i + k AS INT) AS i, CAST(2 * j + l AS INT) AS j, round(w * x.x * y.x, 6) AS w FROM tn JOIN f x ON i = x.ix JOIN f y ON j = y.ix", TIPS, _TIP_NORM, _converged("f", "tm", "contigs")))
def tip_processed_flat(spark, sf):
    return rounded(contact_map(spark, sf, TIP_PARAMS).processed(flatten=True, tol=_END).select(F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "w"), "w")


_EXTENT_DENSE = """
db AS (SELECT bins.bin_id, bins.ix, bin_no, CAST(row_number() OVER (ORDER BY bin_id) - 1 AS INT) AS dense_bin FROM bins JOIN mask ON bins.ix = mask.ix WHERE accepted),
en AS (SELECT a.dense_bin AS i, b.dense_bin AS j, w / (1e-3 * sqrt(CAST(x.length AS DOUBLE) * y.length)) AS w FROM esym JOIN db a ON b1 = a.bin_id JOIN db b ON b2 = b.bin_id JOIN contigs x ON a.ix = x.ix JOIN contigs y ON b.ix = y.ix),
di AS (SELECT dense_bin AS ix FROM db),
nn AS (SELECT db.ix, count(*) AS n FROM db GROUP BY db.ix),
st AS (SELECT ordering.ix, ori, n, coalesce(sum(n) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM ordering JOIN nn ON ordering.ix = nn.ix),
pb AS (SELECT dense_bin, CAST(start + CASE WHEN ori > 0 THEN bin_no ELSE n - 1 - bin_no END AS INT) AS pos FROM db JOIN st ON db.ix = st.ix)"""


@query(sql("SELECT a.pos AS b1, b.pos AS b2, round(w * x.x * y.x, 6) AS w FROM en JOIN f x ON i = x.ix JOIN f y ON j = y.ix JOIN pb a ON i = a.dense_bin JOIN pb b ON j = b.dense_bin", BINS, ORD, _EXTENT_DENSE, _converged("f", "en", "di", 400)))
def extent_processed(spark, sf):
    """The binned map normalised, without masked contigs, balanced, and in an order."""
    return rounded(contact_map(spark, sf).extent_map(bisto=True, ordering=ordering(spark, sf), tol=_END), "w")


@query(sql("SELECT a.pos AS i, b.pos AS j, round(ln(w + 0.01), 6) AS w FROM en JOIN pb a ON i = a.dense_bin JOIN pb b ON j = b.dense_bin", BINS, ORD, _EXTENT_DENSE))
def extent_tiles(spark, sf):
    m = contact_map(spark, sf).extent_map(ordering=ordering(spark, sf)).select(F.col("b1").alias("i"), F.col("b2").alias("j"), "w")
    return rounded(heatmap.log_tiles(m, zero_diagonal=False, times=1.0), "w")


@query(sql("SELECT a.rank AS i, b.rank AS j, round(ln(CASE WHEN norm.i = norm.j THEN 0 ELSE 100 * norm.w * x.x * y.x END + 0.01), 5) AS w FROM norm JOIN f x ON norm.i = x.ix JOIN f y ON norm.j = y.ix JOIN ordering a ON norm.i = a.ix JOIN ordering b ON norm.j = b.ix", _FACTORS, ORD))
def contig_tiles(spark, sf):
    m = contact_map(spark, sf)
    tiles = heatmap.log_tiles(m.subspace(m.processed(tol=_END), ordering(spark, sf)))
    return tiles.withColumn("w", F.round("w", 5))


@query(sql("SELECT a.rank AS i, b.rank AS j, w FROM sym JOIN ordering a ON i = a.ix JOIN ordering b ON j = b.ix", ORD))
def permuted_map(spark, sf):
    return order.permute(symmetric(spark, sf), ordering(spark, sf))


@query(sql("SELECT CAST(2 * a.rank + k2 AS INT) AS rank, CAST(2 * a.ix + CASE WHEN ori > 0 THEN k2 ELSE 1 - k2 END AS INT) AS ix, ori FROM ordering a, (SELECT unnest([0, 1]) AS k2)", ORD))
def doubled_order(spark, sf):
    return order.double_order(ordering(spark, sf)).select(F.col("rank").cast("int").alias("rank"), "ix", "ori")


@query(sql("SELECT CAST(row_number() OVER (ORDER BY NOT accepted, ix) - 1 AS INT) AS pos, ix, accepted AS mask FROM mask"))
def masked_positions(spark, sf):
    out = order.set_mask(order.initial(contigs(spark, sf)), mask(spark, sf))
    return out.select("pos", "ix", "mask")


@query(sql("""SELECT p.a, p.b, CAST(CASE WHEN x.ix < y.ix THEN y.ahead - x.ahead - x.length ELSE x.ahead - y.ahead - y.length END AS BIGINT) AS between_bases
  FROM (SELECT i AS a, j AS b FROM up WHERE i <> j) p
  JOIN ah x ON p.a = x.ix JOIN ah y ON p.b = y.ix""", 'ah AS (SELECT ix, length, "offset" AS ahead FROM contigs)'))
def intervening_lengths(spark, sf):
    p = upper(spark, sf).select(F.col("i").alias("a"), F.col("j").alias("b"))
    return order.intervening(order.initial(contigs(spark, sf)), p).withColumnRenamed("between", "between_bases")


# ---------------------------------------------------------------- heatmap


@query(sql("SELECT CAST(i // 7 AS INT) AS i, CAST(j // 7 AS INT) AS j, round(sum(w) / 49.0, 6) AS w FROM sym GROUP BY 1, 2"))
def downsample_mean(spark, sf):
    return rounded(heatmap.downsample(symmetric(spark, sf), 7), "w")


@query(sql("SELECT CAST(i // 7 AS INT) AS i, CAST(j // 7 AS INT) AS j, CAST(max(w) AS BIGINT) AS w FROM sym GROUP BY 1, 2"))
def downsample_max(spark, sf):
    return heatmap.downsample(symmetric(spark, sf), 7, "max").select("i", "j", F.col("w").cast("bigint").alias("w"))


@query(sql("SELECT i, j, round(ln(CASE WHEN i = j THEN 0.0 ELSE w * 100.0 END + 0.01), 6) AS w FROM norm"))
def heatmap_log_tiles(spark, sf):
    return rounded(heatmap.log_tiles(normalise.by_sites(symmetric(spark, sf), contigs(spark, sf))), "w")


@query(sql("SELECT i, j FROM sym WHERE w <> 0"))
def heatmap_pattern(spark, sf):
    return heatmap.pattern(symmetric(spark, sf))


@query(sql("SELECT rank AS tick, CASE WHEN ori < 0 THEN '- ' ELSE '+ ' END || name AS label FROM ordering JOIN contigs ON ordering.ix = contigs.ix", ORD))
def contig_labels(spark, sf):
    return heatmap.contig_labels(ordering(spark, sf), contigs(spark, sf))


# ---------------------------------------------------------------- graph


@query(sql("SELECT i AS u, j AS v, round(w / (SELECT max(w) FROM norm), 6) AS weight FROM norm WHERE i <= j AND w > 0"))
def contact_edges_scaled(spark, sf):
    return rounded(graph.contact_edges(normalise.by_sites(symmetric(spark, sf), contigs(spark, sf))), "weight")


_HEAVY = "heavy AS (SELECT u, v, weight FROM edges WHERE weight >= 4)"


@query(sql("SELECT ix AS node FROM contigs WHERE ix NOT IN (SELECT u FROM heavy WHERE u <> v UNION SELECT v FROM heavy WHERE u <> v)", _HEAVY))
def isolates_antijoin(spark, sf):
    return graph.isolates(contigs(spark, sf).select(F.col("ix").alias("node")), edges(spark, sf).where("weight >= 4"))


@query(sql("SELECT node, CASE WHEN node IN (SELECT u FROM heavy WHERE u <> v UNION SELECT v FROM heavy WHERE u <> v) THEN cl ELSE 1 + (SELECT coalesce(max(cl), -1) FROM part WHERE node IN (SELECT u FROM heavy WHERE u <> v UNION SELECT v FROM heavy WHERE u <> v)) END AS cl FROM part", _HEAVY))
def ragbag(spark, sf):
    nodes = contigs(spark, sf).select(F.col("ix").alias("node"))
    return graph.with_ragbag(partition(spark, sf), nodes, edges(spark, sf).where("weight >= 4"))


@query(sql("SELECT u, v, weight, CAST(r AS INT) AS rank FROM (SELECT u, v, weight, row_number() OVER (PARTITION BY u ORDER BY weight DESC, v) AS r FROM both_ways) WHERE r <= 5"))
def topk_neighbours(spark, sf):
    return graph.top_neighbours(edges(spark, sf), 4)


_NEAR = """
top AS (SELECT u, v FROM (SELECT u, v, row_number() OVER (PARTITION BY u ORDER BY weight DESC, v) AS r FROM both_ways) WHERE r <= 5),
hood AS (SELECT u, v FROM top UNION SELECT a.u, b.v FROM top a JOIN top b ON a.v = b.u WHERE a.u <> a.v),
cov AS (SELECT ix, length, CAST(1.5 + ix % 37 AS DOUBLE) AS cov FROM contigs),
loc AS (SELECT u AS ix, exp(avg(ln(cov))) AS local_cov FROM hood JOIN cov ON hood.v = cov.ix GROUP BY u)
"""


@query(sql("SELECT cov.ix, cov / local_cov > 2 AS is_degenerate, round(cov, 6) AS cov, round(local_cov, 6) AS local_cov, round(cov / local_cov, 6) AS fold FROM cov JOIN loc ON cov.ix = loc.ix WHERE length >= 5000", _NEAR))
def degenerate_report(spark, sf):
    dim = contigs(spark, sf).select("ix", "length", (F.lit(1.5) + F.col("ix") % 37).cast("double").alias("cov"))
    return rounded(graph.degenerates(edges(spark, sf), dim, 2.0, 5000), "cov", "local_cov", "fold")


@query("WITH RECURSIVE " + BASE + """,
sp AS (SELECT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v),
reach AS (SELECT DISTINCT u AS node, u AS seen FROM sp UNION SELECT reach.node, sp.v FROM reach JOIN sp ON reach.seen = sp.u)
SELECT node, min(seen) AS component FROM reach GROUP BY node""")
def connected_components(spark, sf):
    return components.connected_components(edges(spark, sf))


@query(sql("SELECT comm, node, max(strength) AS strength FROM (SELECT cl AS comm, node, CAST(1.0 AS DOUBLE) AS strength FROM part UNION ALL SELECT b.cl, a.node, CAST(0.5 AS DOUBLE) FROM both_ways e JOIN part a ON e.u = a.node JOIN part b ON e.v = b.node WHERE a.cl <> b.cl) GROUP BY comm, node"))
def soft_membership_simple(spark, sf):
    return graph.soft_membership(edges(spark, sf), partition(spark, sf))


@query(sql("SELECT comm, node, max(strength) AS strength FROM (SELECT cl AS comm, node, CAST(1.0 AS DOUBLE) AS strength FROM part UNION ALL SELECT b.cl, a.node, CAST(0.5 AS DOUBLE) FROM both_ways e JOIN mx ON e.u = mx.u AND e.weight = mx.top JOIN part a ON e.u = a.node JOIN part b ON e.v = b.node WHERE a.cl <> b.cl) GROUP BY comm, node", "mx AS (SELECT u, max(weight) AS top FROM both_ways GROUP BY u)"))
def soft_membership_maxaff(spark, sf):
    return graph.soft_membership(edges(spark, sf), partition(spark, sf), "maxaff")


@query(sql("SELECT cl, e.u, e.v, e.weight FROM (SELECT e.*, a.cl, b.cl AS cb FROM edges e JOIN part a ON e.u = a.node JOIN part b ON e.v = b.node) e WHERE cl = cb"))
def decomposed_graph(spark, sf):
    return graph.members_inside(edges(spark, sf), partition(spark, sf))


_ST = """
st AS (SELECT node, sum(weight) AS s FROM (SELECT u AS node, weight FROM edges UNION ALL SELECT v, weight FROM edges) GROUP BY node),
whole AS (SELECT sum(weight) AS m FROM edges),
ins AS (SELECT a.cl, sum(CASE WHEN a.cl = b.cl THEN weight ELSE 0 END) AS w FROM edges JOIN part a ON u = a.node JOIN part b ON v = b.node GROUP BY a.cl),
tot AS (SELECT cl, sum(s) AS s FROM st JOIN part ON st.node = part.node GROUP BY cl)
"""


@query(sql("SELECT round(sum(coalesce(w, 0) / m - (s / (2 * m)) * (s / (2 * m))), 6) AS modularity FROM tot LEFT JOIN ins ON tot.cl = ins.cl, whole", _ST))
def modularity_of_partition(spark, sf):
    return rounded(graph.modularity(edges(spark, sf), partition(spark, sf)), "modularity")


_FLOW = """
fl AS (SELECT u, v, weight FROM edges WHERE u <> v),
w2 AS (SELECT 2 * sum(weight) AS w2 FROM fl),
np AS (SELECT node, sum(weight) / (SELECT w2 FROM w2) AS p FROM (SELECT u AS node, weight FROM fl UNION ALL SELECT v, weight FROM fl) GROUP BY node),
ct AS (SELECT a.cl, sum(weight) / (SELECT w2 FROM w2) AS q FROM (SELECT u, v, weight FROM fl UNION ALL SELECT v, u, weight FROM fl) e JOIN part a ON u = a.node JOIN part b ON v = b.node WHERE a.cl <> b.cl GROUP BY a.cl),
md AS (SELECT part.cl, sum(p) AS p, coalesce(max(q), 0) AS q FROM np JOIN part ON np.node = part.node LEFT JOIN ct ON part.cl = ct.cl GROUP BY part.cl),
ag AS (SELECT sum(q) AS q, sum(CASE WHEN q > 0 THEN q * log2(q) ELSE 0 END) AS lq, sum((p + q) * log2(p + q)) AS lpq FROM md)
"""


@query(sql("SELECT round(q * log2(q) - 2 * lq - (SELECT sum(p * log2(p)) FROM np) + lpq, 6) AS codelength FROM ag", _FLOW))
def codelength_of_partition(spark, sf):
    return rounded(graph.codelength(edges(spark, sf), partition(spark, sf)), "codelength")


def _mcl_sql(steps: int) -> str:
    out = """fl AS (SELECT u AS i, v AS j, weight AS w FROM edges WHERE u <> v UNION ALL SELECT v, u, weight FROM edges WHERE u <> v),
lp AS (SELECT j AS i, j, max(w) AS w FROM fl GROUP BY j),
al0 AS (SELECT * FROM fl UNION ALL SELECT * FROM lp UNION ALL SELECT u, v, 1.0 FROM edges WHERE u = v AND u NOT IN (SELECT j FROM lp)),
m0 AS (SELECT i, j, w / sum(w) OVER (PARTITION BY j) AS w FROM al0)"""
    for k in range(steps):
        out += f""",
s{k} AS (SELECT a.i, b.j, pow(sum(a.w * b.w), 1.2) AS w FROM m{k} a JOIN m{k} b ON a.j = b.i GROUP BY a.i, b.j),
m{k + 1} AS (SELECT i, j, w / sum(w) OVER (PARTITION BY j) AS w FROM s{k})"""
    return out


@query(sql("SELECT i, j, round(w, 6) AS w FROM m2", _mcl_sql(2)))
def mcl_iteration_2(spark, sf):
    from pairloom.session import materialise

    return rounded(clustering.mcl_iterated(materialise(clustering.mcl_start(edges(spark, sf))), 2), "w")


@query()
def louvain_clusters(spark, sf):
    return clustering.louvain(edges(spark, sf))


@query()
def mapeq_clusters(spark, sf):
    return clustering.map_equation(edges(spark, sf), trials=10)


@query()
def mcl_clusters(spark, sf):
    return clustering.mcl(edges(spark, sf))


@query()
def slm_clusters(spark, sf):
    return clustering.smart_local_moving(edges(spark, sf))


# ---------------------------------------------------------------- clusters

_RANKED = """
ex AS (SELECT cl_id, count(*) AS size, CAST(sum(length) AS BIGINT) AS extent, min(members.ix) AS head FROM members JOIN contigs ON members.ix = contigs.ix GROUP BY cl_id),
rk AS (SELECT *, CAST(row_number() OVER (ORDER BY extent DESC, head) - 1 AS INT) AS r, count(*) OVER () AS n FROM ex),
named AS (SELECT cl_id AS old, r AS cl_id, 'CL' || lpad(CAST(r + 1 AS VARCHAR), CAST(greatest(CAST(ceil(log10(n)) AS INT), 1, length(CAST(r + 1 AS VARCHAR))) AS INT), '0') AS name, size, extent FROM rk)
"""


@query(sql("SELECT cl_id, name, size, extent FROM named", _RANKED))
def cluster_extent_rank_names(spark, sf):
    return report.ranked(members(spark, sf), contigs(spark, sf))[1]


@query(sql("SELECT cl_id, name, size, extent FROM named WHERE extent >= 50000", _RANKED))
def cluster_filter_min_extent(spark, sf):
    return report.filtered(report.ranked(members(spark, sf), contigs(spark, sf))[1], 50_000)


@query(sql("""SELECT line_no, line FROM (
  SELECT row_number() OVER (ORDER BY cl_id) - 1 AS line_no, line FROM (SELECT cl_id, string_agg(name, ' ' ORDER BY mm.ix) AS line FROM mm JOIN contigs ON mm.ix = contigs.ix GROUP BY cl_id)
  UNION ALL SELECT (SELECT count(DISTINCT cl_id) FROM mm) + row_number() OVER (ORDER BY ix) - 1, name FROM contigs WHERE ix NOT IN (SELECT ix FROM mm))""",
  "mm AS (SELECT cl_id, ix FROM members WHERE ix % 6 <> 5)"))
def mcl_membership_lines(spark, sf):
    return report.membership_lines(members(spark, sf).where("ix % 6 <> 5"), contigs(spark, sf))


@query(sql("SELECT tick, label FROM (SELECT CAST(0 AS BIGINT) AS tick, name AS label, 0 AS k FROM named WHERE cl_id = 0 UNION ALL SELECT CAST(sum(size) OVER (ORDER BY cl_id) AS BIGINT), lead(name) OVER (ORDER BY cl_id), 1 FROM named)", _RANKED))
def cluster_ticks(spark, sf):
    return heatmap.cluster_ticks(report.ranked(members(spark, sf), contigs(spark, sf))[1])


def _doc_clusters(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sequences as contigs in 25 clusters."""
    seqs = adapters.sequences(spark, sf)
    dim = seqs.select("ix", F.col("seq_name").alias("name"), "length")
    moved, clusters = report.ranked(dim.select((F.col("ix") % 25).alias("cl_id"), "ix"), dim)
    return report.member_stats(moved, dim, seqs), clusters, moved


_DOCS = """
cm AS (SELECT ix % 25 AS old, ix, length, seq_name, seq FROM seqs),
dr AS (SELECT old, CAST(row_number() OVER (ORDER BY sum(length) DESC, min(ix)) - 1 AS INT) AS id, count(*) AS size, CAST(sum(length) AS BIGINT) AS extent, count(*) OVER () AS n FROM cm GROUP BY old),
ms AS (SELECT id, ix, length, CASE WHEN length > 0 THEN 100.0 * length(regexp_replace(seq, '[^GCSgcs]', '', 'g')) / length ELSE 0 END AS gc,
  TRY_CAST(regexp_extract(seq_name, '_cov_([0-9.]+)$', 1) AS DOUBLE) AS cov FROM cm JOIN dr ON cm.old = dr.old),
n5 AS (SELECT id, max(length) AS n50 FROM (SELECT id, length, sum(length) OVER (PARTITION BY id ORDER BY length DESC, ix ROWS UNBOUNDED PRECEDING) AS cum, sum(length) OVER (PARTITION BY id) AS total FROM ms) WHERE 2 * cum > total GROUP BY id)
"""
_STAT = ", ".join(
    f"round(sum(ms.length * {c}) / sum(ms.length), 6) AS {c}_expect, round(avg({c}), 6) AS {c}_mean, round(median({c}), 6) AS {c}_median, round(stddev_pop({c}), 6) AS {c}_std" for c in ("gc", "cov")
)


@query(seq_sql(f"SELECT ms.id, 'CL' || lpad(CAST(ms.id + 1 AS VARCHAR), CAST(greatest(CAST(ceil(log10(max(n))) AS INT), 1, length(CAST(ms.id + 1 AS VARCHAR))) AS INT), '0') AS name, count(*) AS size, CAST(sum(ms.length) AS BIGINT) AS extent, max(n50) AS n50, {_STAT} FROM ms JOIN n5 ON ms.id = n5.id JOIN dr ON ms.id = dr.id GROUP BY ms.id", _DOCS))
def cluster_report(spark, sf):
    stats, clusters, _ = _doc_clusters(spark, sf)
    out = report.cluster_report(stats, clusters)
    return rounded(out, *[c for c in out.columns if c.startswith(("gc", "cov"))])


@query(seq_sql("SELECT id AS cl_id, n50 FROM n5", _DOCS))
def n50_per_cluster(spark, sf):
    return report.n50(_doc_clusters(spark, sf)[0])


# ---------------------------------------------------------------- sequences


@query(seq_sql("SELECT seq_name, CAST((length - length(replace(seq, 'AATT', ''))) / 4 - CASE WHEN starts_with(seq, 'AATT') THEN 1 ELSE 0 END + (length - length(replace(seq, 'CCGG', ''))) / 4 AS INT) AS sites FROM seqs"))
def site_counts(spark, sf):
    seqs = adapters.sequences(spark, sf)
    return sequences.with_sites(seqs, [sequences.enzyme("MluCI"), sequences.enzyme("HpaII")]).select("seq_name", "sites")


@query(seq_sql("SELECT seq_name, round(CASE WHEN length > 0 THEN 100.0 * length(regexp_replace(seq, '[^GCSgcs]', '', 'g')) / length ELSE 0 END, 6) AS gc FROM seqs"))
def gc_content(spark, sf):
    return adapters.sequences(spark, sf).select("seq_name", F.round(scalar.gc_percent(F.col("seq")), 6).alias("gc"))


_FRAG = """
fc AS (SELECT seq_name, seq, length, CAST(greatest(1, floor(CAST(length AS DOUBLE) / 500 + 0.333)) AS INT) AS n FROM seqs),
fr AS (SELECT seq_name, seq, CAST(CASE WHEN k = n THEN length ELSE floor(k * (CAST(length AS DOUBLE) / n)) END AS INT) AS s, CAST(CASE WHEN k + 1 = n THEN length ELSE floor((k + 1) * (CAST(length AS DOUBLE) / n)) END AS INT) AS e FROM (SELECT *, unnest(range(n)) AS k FROM fc))
"""


@query(seq_sql("SELECT seq_name || '.' || s || '_' || e AS frag_id, seq_name, s AS \"start\", e AS \"end\", substr(seq, s + 1, e - s) AS seq FROM fr", _FRAG))
def split_fragments(spark, sf):
    return sequences.split_fragments(adapters.sequences(spark, sf), 500)


@query(seq_sql("SELECT (SELECT count(*) FROM seqs) AS n_seqs, (SELECT round(avg(length), 6) FROM seqs) AS mean_length, (SELECT max(length) FROM seqs) AS max_length, count(*) AS n_fragments, round(avg(e - s), 6) AS mean_fragment, max(e - s) AS max_fragment FROM fr", _FRAG))
def split_stats(spark, sf):
    seqs = adapters.sequences(spark, sf)
    return rounded(sequences.split_stats(seqs, sequences.split_fragments(seqs, 500)), "mean_length", "mean_fragment")


@query(seq_sql("SELECT seq_name, reverse(translate(seq, 'ACGT', 'TGCA')) AS seq FROM seqs"))
def reverse_complement(spark, sf):
    return adapters.sequences(spark, sf).select("seq_name", scalar.reverse_complement(F.col("seq")).alias("seq"))


@query(seq_sql("SELECT seq_name, TRY_CAST(regexp_extract(seq_name, '_cov_([0-9.]+)$', 1) AS DOUBLE) AS cov FROM seqs"))
def coverage_from_name(spark, sf):
    return adapters.sequences(spark, sf).select("seq_name", scalar.coverage_from_name(F.col("seq_name")).alias("cov"))


# ---------------------------------------------------------------- likelihood

_PARETO = "CASE WHEN s < 500000 THEN 0.122123774414444 / 13.675170758388262 * pow(1 + (s - 13.973247315647466) / 13.675170758388262, -0.122123774414444 - 1) ELSE 2e-8 END"


@query(sql(f"SELECT ix, round({_PARETO}, 9) AS density FROM (SELECT ix, CAST(\"offset\" + 100 AS DOUBLE) AS s FROM contigs)"))
def pareto_density(spark, sf):
    return contigs(spark, sf).select("ix", F.round(scalar.pareto_density((F.col("offset") + 100).cast("double")), 9).alias("density"))


@query(sql("SELECT round(-sum(CASE WHEN w > 0 THEN w * ln(w / e) + e - w + 0.5 * ln(2 * pi() * w) ELSE e END), 6) AS loglik FROM (SELECT CAST(w AS DOUBLE) AS w, (a.length + b.length) / 20000.0 AS e FROM sym JOIN contigs a ON i = a.ix JOIN contigs b ON j = b.ix)"))
def poisson_loglik(spark, sf):
    a = contigs(spark, sf).select(F.col("ix").alias("i"), F.col("length").alias("la"))
    b = contigs(spark, sf).select(F.col("ix").alias("j"), F.col("length").alias("lb"))
    rows = symmetric(spark, sf).join(a, "i").join(b, "j").select(F.col("w").alias("observed"), ((F.col("la") + F.col("lb")) / 20000.0).alias("expected"))
    return rounded(likelihood.poisson_loglik(rows), "loglik")


_SMALL = f"""
sc AS (SELECT ix, length, "offset" AS ahead FROM contigs),
pr AS (SELECT x.bin_id AS e1, y.bin_id AS e2, abs(b.ahead - a.ahead - a.length + 0.5 * (a.length + b.length) + y.center - x.center) AS s
  FROM sc a JOIN sc b ON a.ix < b.ix JOIN bins x ON x.ix = a.ix JOIN bins y ON y.ix = b.ix),
oe AS (SELECT coalesce(w, 0) AS w, 1000.0 * ({_PARETO}) AS e FROM pr LEFT JOIN ext ON b1 = least(e1, e2) AND b2 = greatest(e1, e2))
"""


@query(sql("SELECT round(-sum(CASE WHEN w > 0 THEN w * ln(w / e) + e - w + 0.5 * ln(2 * pi() * w) ELSE e END), 6) AS loglik FROM oe", BINS, _SMALL))
def order_likelihood(spark, sf):
    return rounded(likelihood.log_likelihood(extent(spark, sf), bins(spark, sf), order.initial(contigs(spark, sf)), total=1000.0), "loglik")


# ---------------------------------------------------------------- further operators


@query(seq_sql("SELECT id AS cl_id, ix, length, round(gc, 6) AS gc, cov FROM ms", _DOCS))
def member_stats(spark, sf):
    return rounded(_doc_clusters(spark, sf)[0], "gc")


@query(seq_sql("""SELECT name, CAST(r AS INT) AS rank, name || '_' || lpad(CAST(r AS VARCHAR), CAST(greatest(CAST(ceil(log10(size + 1)) AS INT), 1, length(CAST(r AS VARCHAR))) AS INT), '0') AS record_id,
  'contig:' || seq_name || ' ori:UNKNOWN length:' || length AS description, seq FROM (
  SELECT cm.*, size, 'CL' || lpad(CAST(id + 1 AS VARCHAR), CAST(greatest(CAST(ceil(log10(n)) AS INT), 1, length(CAST(id + 1 AS VARCHAR))) AS INT), '0') AS name,
    row_number() OVER (PARTITION BY cm.old ORDER BY ix) AS r FROM cm JOIN dr ON cm.old = dr.old WHERE extent >= 20000)""", _DOCS))
def cluster_fasta_records(spark, sf):
    seqs = adapters.sequences(spark, sf)
    dim = seqs.select("ix", F.col("seq_name").alias("name"), "length")
    _, clusters, moved = _doc_clusters(spark, sf)
    return report.fasta_records(moved, clusters, dim, seqs, 20_000)


@query(sql("SELECT ix, name FROM contigs WHERE ix NOT IN (SELECT ix FROM members WHERE cl_id < 7)"))
def lost_contigs(spark, sf):
    return report.lost_contigs(contigs(spark, sf), members(spark, sf).where("cl_id < 7")).select("ix", "name")


@query(sql("SELECT CAST(row_number() OVER (ORDER BY named.cl_id, members.ix) - 1 AS INT) AS rank, members.ix, 1 AS ori FROM named JOIN members ON named.old = members.cl_id WHERE extent >= 50000", _RANKED))
def enabled_cluster_order(spark, sf):
    moved, clusters = report.ranked(members(spark, sf), contigs(spark, sf))
    return report.concatenated_order(report.filtered(clusters, 50_000), moved).select("rank", "ix", F.col("ori").cast("int").alias("ori"))


_ENDS = """
en AS (SELECT seq_name, CASE WHEN length < 400 THEN substr(seq, 1, length // 2) ELSE substr(seq, 1, 200) END AS h, CASE WHEN length < 400 THEN substr(seq, length // 2 + 1) ELSE substr(seq, length - 199) END AS t FROM seqs)
"""
_AATT = "CAST((length({x}) - length(replace({x}, 'AATT', ''))) / 4 - CASE WHEN starts_with({x}, 'AATT') THEN 1 ELSE 0 END AS INT)"


@query(seq_sql(f"SELECT seq_name, {_AATT.format(x='h')} AS head_sites, {_AATT.format(x='t')} AS tail_sites FROM en", _ENDS))
def tip_site_counts(spark, sf):
    out = sequences.with_sites(adapters.sequences(spark, sf), [sequences.enzyme("MluCI")], 200)
    return out.select("seq_name", F.col("sites")[0].alias("head_sites"), F.col("sites")[1].alias("tail_sites"))


@query(seq_sql("SELECT seq_name, rtrim(regexp_replace(seq, '(.{60})', '\\1' || chr(10), 'g'), chr(10)) AS lines FROM seqs"))
def wrapped_sequences(spark, sf):
    return adapters.sequences(spark, sf).select("seq_name", sequences.wrapped(F.col("seq")).alias("lines"))


@query(sql("SELECT node, sum(weight) AS strength FROM (SELECT u AS node, weight FROM edges UNION ALL SELECT v, weight FROM edges) GROUP BY node"))
def node_strengths(spark, sf):
    return graph.strengths(edges(spark, sf))


@query(sql("SELECT u, v FROM hood", _NEAR))
def neighbourhoods(spark, sf):
    return graph.neighbourhood(edges(spark, sf))


@query(sql("SELECT i, j, round(w, 6) AS w FROM m0", _mcl_sql(0)))
def mcl_start_matrix(spark, sf):
    return rounded(clustering.mcl_start(edges(spark, sf)), "w")


@query(sql("SELECT i, j, round(w / (1e-3 * (0.5 * (CAST(a.length AS DOUBLE) + b.length))), 6) AS w FROM sym JOIN contigs a ON i = a.ix JOIN contigs b ON j = b.ix"))
def length_normalised_map_arithmetic(spark, sf):
    return rounded(normalise.by_length(symmetric(spark, sf), contigs(spark, sf), "arithmetic"), "w")


@query(sql("SELECT i, j, round(w * (1 + i % 3) * (1 + j % 3), 6) AS w FROM norm"))
def scaled_by_vector(spark, sf):
    x = contigs(spark, sf).select("ix", (1 + F.col("ix") % 3).cast("double").alias("x"))
    return rounded(normalise.scaled(normalise.by_sites(symmetric(spark, sf), contigs(spark, sf)), x), "w")


@query(sql("SELECT CAST(row_number() OVER (ORDER BY ix) - 1 AS INT) AS rank, ix, CASE WHEN ix = 4 THEN -1 ELSE 1 END AS ori FROM contigs WHERE ix <> 2"))
def flipped_and_masked_order(spark, sf):
    own = order.flip(order.mask_one(order.initial(contigs(spark, sf)), 2), 4)
    return order.accepted_positions(own).select("rank", "ix", F.col("ori").cast("int").alias("ori"))


@query(sql("""SELECT m.ix, CAST(coalesce(o.rank, (SELECT count(*) FROM ordering) + row_number() OVER (PARTITION BY o.rank IS NULL ORDER BY m.ix) - 1) AS INT) AS pos,
  CAST(coalesce(o.ori, 1) AS INT) AS ori, o.rank IS NOT NULL AS mask FROM mask m LEFT JOIN ordering o ON m.ix = o.ix""", ORD))
def order_taken_over(spark, sf):
    own = order.set_mask(order.initial(contigs(spark, sf)), mask(spark, sf))
    out = order.set_order(own, ordering(spark, sf))
    return out.select("ix", "pos", F.col("ori").cast("int").alias("ori"), "mask")


@query(sql("SELECT up.i AS a, up.j AS b, a.rank < b.rank AS is_before FROM up JOIN ordering a ON up.i = a.ix JOIN ordering b ON up.j = b.ix WHERE up.i <> up.j", ORD))
def order_before(spark, sf):
    own = ordering(spark, sf)
    x, y = own.select(F.col("ix").alias("a"), F.col("rank").alias("ra")), own.select(F.col("ix").alias("b"), F.col("rank").alias("rb"))
    met = upper(spark, sf).where("i <> j").select(F.col("i").alias("a"), F.col("j").alias("b"))
    return met.join(x, "a").join(y, "b").select("a", "b", order.before(F.col("ra"), F.col("rb")).alias("is_before"))


@query(sql("SELECT count(*) AS n FROM inf"))
def informative_count(spark, sf):
    return pairs.informative(adapters.alignments(spark, sf)).agg(F.count("*").alias("n"))


@query(sql("SELECT refid, name FROM refs WHERE length >= 1000 AND refid % 5 = 0"))
def missing_sequences(spark, sf):
    refs = adapters.refs(spark, sf)
    known = refs.where("refid % 5 <> 0").select(F.col("name").alias("seq_name"))
    return contacts.missing_sequences(refs, known, PARAMS.min_len).select("refid", "name")
