"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents become sets of hashed five-word shingles.  Documents with equal sets are one class; all further work is on classes, so thousands of
copies cost as much as one text.  Classes that agree on a band of MinHash values may be similar, and are compared in two rounds:

- Each class with the first class of each of its buckets, every such pair once however many bands it shares.  This ties groups of near copies
  together with a row per class and leader, not per pair.
- Where a bucket still holds classes that aren't tied, those of different ties are compared, in blocks of the bucket.

A comparison goes through the MinHash values step by step and drops the pair as soon as the posterior probability that its similarity reaches the
threshold falls below ``TOLERANCE``.  What is left ties classes to candidate components; within these, in pairs of blocks, pairs are pruned once
more and the shingle sets decide exactly, pair by pair or, where most pairs are left, by a product of incidence matrices.  Tasks return sums and one
tie per class, never a row per pair.  The comparisons within a group of n different near copies grow with n squared, as all links are counted; a row
is sent to as many jobs as its group has blocks, which are at most 64 for groups of up to 131,072 classes.

With 32 bands of 5 values a pair at similarity 0.8 is missed with probability (1 - 0.8^5)^32 = 3e-6.

Words are separated by white space and compared in lower case; a text of fewer than five words is one shingle of all its words.  Ids can be of any
type with an order.  Defined results: null, empty and wordless texts are in no group: their class is their own id, with no links; a null id counts
as the largest in choosing a class id, and equal ids go by their texts' hashes; repeated rows are copies of each other; a similarity of exactly 0.8
is a link; a very long text is one set, held whole by a task; an empty table gives an empty table.  Only the named columns are read; others can
have any names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairloom.llm.common import materialise, release, unused_name
from pairloom.operators.components import connected_components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: A pair is dropped when the chance that it reaches the threshold is below this.
TOLERANCE = 1e-6
#: Classes of a block of a bucket and of a component at most, shingles of the latter (these bound what a task holds), and rows up to which a table of
#: ids is broadcast.
BUCKET_BLOCK, BLOCK, BLOCK_SHINGLES, BROADCAST_ROWS = 2048, 2048, 3_000_000, 300_000
#: Classes of a block at least, and blocks that a group is cut into before its blocks grow: small groups make small jobs, large ones few copies.
LEAST_BLOCK, BLOCKS = 256, 64
#: Pairs that are compared at once, bytes of jobs that a partition gets on average, and columns of an incidence matrix.
STRIP, JOB_BYTES, COLUMNS = 400_000, 32 << 20, 4096
_SLICE = 200_000

_random = np.random.default_rng(20_240_501)
_A = (_random.integers(0, 1 << 31, HASHES, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_B = _random.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so every bit of a shingle's number depends on all its words."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hash of each word, kept for the words met so far."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None, words: Words) -> np.ndarray:
    """The sorted distinct shingle numbers of a text."""
    own = text.lower().split() if text else []
    if not own:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, own), np.uint64, len(own))
    n = max(1, len(own) - WORDS + 1)
    key = np.full(n, min(len(own), WORDS), np.uint64)
    for k in range(min(WORDS, len(own))):
        key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(key)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """HASHES 16-bit MinHash values of each set (of non-empty sets)."""
    out = np.empty((len(sets), HASHES), np.uint16)
    first = 0
    while first < len(sets):
        last, total = first, 0
        while last < len(sets) and (last == first or total < _SLICE):
            total += len(sets[last])
            last += 1
        x = np.concatenate(sets[first:last])
        x = (x >> np.uint64(32)).astype(np.uint32) ^ x.astype(np.uint32)
        starts = np.cumsum([0, *(len(s) for s in sets[first : last - 1])])
        for i in range(HASHES):
            least = np.minimum.reduceat(x * _A[i] + _B[i], starts)
            out[first:last, i] = (_mixed(least.astype(np.uint64) + np.uint64(i)) & np.uint64(0xFFFF)).astype(np.uint16)
        first = last
    return out


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _signed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = Words()
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            part = batch.slice(lo, 1000)
            sets = [shingles(t, words) for t in part.column(2).to_pylist()]
            full = [s for s in sets if len(s)]
            rows = iter(signatures(full)) if full else iter(())
            sig = [next(rows).tobytes() if len(s) else None for s in sets]
            cls = [_digest(s) if len(s) else None for s in sets]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(cls, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary())], ["doc_id", "text_hash", "cls", "n", "sig"])


def _least_matches(steps: tuple[int, ...]) -> list[int]:
    """For each number of compared values: the fewest agreements at which the posterior (from a flat prior) still reaches the tolerance."""
    s = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for t in steps:
        low = 0
        for m in range(t + 1):
            log = m * np.log(s) + (t - m) * np.log(1 - s)
            p = np.exp(log - log.max())
            if p[s >= THRESHOLD].sum() / p.sum() >= TOLERANCE:
                low = m
                break
        out.append(low)
    return out


_STEPS = (16, 32, 64, 96, 128, 160)
_LEAST = _least_matches(_STEPS)


def _pruned(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs (row of a, row of b) that survive the comparison of their MinHash values."""
    agreed, done = np.zeros(len(x), np.int16), 0
    for step, least in zip(_STEPS, _LEAST, strict=True):
        for lo in range(0, len(x), 65_536):
            part = slice(lo, lo + 65_536)
            agreed[part] += (a[x[part], done:step] == b[y[part], done:step]).sum(axis=1, dtype=np.int16)
        keep = agreed >= least
        x, y, agreed, done = x[keep], y[keep], agreed[keep], step
    return x, y


def candidate_pairs(sig: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two blocks (rows of ``sig``) that may be similar, each once; with groups, only pairs of different ones."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    rows = max(1, STRIP // max(1, len(right)))
    for lo in range(0, len(left), rows):
        own = left[lo : lo + rows]
        a, b = n[own][:, None], n[right][None, :]
        fits = 10 * np.minimum(a, b) >= 8 * np.maximum(a, b)
        if same:
            fits &= own[:, None] < right[None, :]
        if group is not None:
            fits &= group[own][:, None] != group[right][None, :]
        x, y = np.nonzero(fits)
        found.append(_pruned(sig, sig, own[x], right[y]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component, for pairs of numbers below n."""
    label = np.arange(n)
    while len(x):
        low = np.minimum(label[x], label[y])
        before = label.copy()
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def _jobs(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows of each job, from batches sorted by job; a job's rows may lie in several batches."""
    held: dict[str, list] = {}
    last = None
    for batch in batches:
        columns = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        jobs = [*zip(columns["grp"], columns["i"], columns["j"], strict=True)]
        at = 0
        while at < len(jobs):
            end = at
            while end < len(jobs) and jobs[end] == jobs[at]:
                end += 1
            if jobs[at] != last and held:
                yield held
                held = {}
            last = jobs[at]
            for name, values in columns.items():
                held.setdefault(name, []).extend(values[at:end])
            at = end
    if held:
        yield held


def _sides(job: dict[str, list]) -> tuple[np.ndarray, np.ndarray, bool]:
    """Rows of the two blocks of a job; whether they are one block."""
    i, j, chunk = job["i"][0], job["j"][0], np.array(job["chunk"])
    first = np.nonzero(chunk == i)[0]
    return (first, first, True) if i == j else (first, np.nonzero(chunk == j)[0], False)


def block_jobs(rows: DataFrame, group: str, block: int, load: str | None = None) -> DataFrame:
    """Rows with (grp, i, j, chunk): each goes to all pairs of blocks that its block takes part in.

    Groups with one row are left out; a group of k blocks has k (k + 1) / 2 jobs.
    """
    weight = F.col(load) if load else F.lit(1)
    sizes = rows.groupBy(group).agg(F.count("*").alias("members"), F.sum(weight).alias("total")).where("members > 1")
    size = F.least(F.greatest(F.ceil(F.col("members") / BLOCKS), F.lit(LEAST_BLOCK)), F.lit(block))
    blocks = F.greatest(F.ceil(F.col("members") / size), F.ceil(F.col("total") / BLOCK_SHINGLES) if load else F.lit(1)).cast("int")
    # the sizes are joined, not counted in a window: a large group's rows never meet in one task
    joined = rows.join(sizes.select(group, blocks.alias("k")), group).withColumn("chunk", F.pmod(F.hash("num"), F.col("k")))
    dealt = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return dealt.select(F.col(group).alias("grp"), F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), *[c for c in rows.columns if c != group], "chunk")


def _compared(jobs: DataFrame, details: DataFrame, row_bytes: int, compare: Callable, result: str, load: str | None = None) -> DataFrame:
    """What ``compare`` makes of jobs whose rows carry their details (num, ...); as many partitions as their bytes ask for."""
    jobs = materialise(jobs)
    held = F.lit(row_bytes) + (8 * F.col(load) if load else 0)
    size = jobs.agg(F.coalesce(F.sum(held), F.lit(0))).first()[0]
    parts = max(int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / JOB_BYTES))
    full = jobs.drop(*([load] if load else [])).join(details, "num")
    made = materialise(full.repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j").mapInArrow(compare, result))
    release(jobs)
    return made


def _edges(u: list, v: list) -> pa.RecordBatch:
    return pa.record_batch([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def _led(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties (u, v) from rows (num, n, sig, leader, leader_n, leader_sig) that may reach the threshold."""
    for batch in batches:
        if not batch.num_rows:
            continue
        num, n, sig, leader, m, other = batch.columns
        a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint16).reshape(-1, HASHES) for c in (sig, other))
        na, nb = n.to_numpy(zero_copy_only=False), m.to_numpy(zero_copy_only=False)
        fits = np.nonzero(10 * np.minimum(na, nb) >= 8 * np.maximum(na, nb))[0]
        kept = pa.array(_pruned(a, b, fits, fits)[0])
        yield pa.record_batch([num.take(kept), leader.take(kept)], ["u", "v"])


def _ties(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties (u, v) between classes of a bucket that may reach the threshold: each class with the first of its component in the job."""
    u: list[int] = []
    v: list[int] = []
    for job in _jobs(batches):
        left, right, same = _sides(job)
        if not len(left) or not len(right):
            continue
        sig = np.frombuffer(b"".join(job["sig"]), np.uint16).reshape(-1, HASHES)
        x, y = candidate_pairs(sig, np.array(job["n"]), left, right, same, np.array(job["tied"]))
        if len(x):
            num = np.array(job["num"])
            label = _roots(len(num), x, y)
            moved = np.nonzero(label != np.arange(len(num)))[0]
            u += num[moved].tolist()
            v += num[label[moved]].tolist()
        if len(u) > 20_000:
            yield _edges(u, v)
            u, v = [], []
    yield _edges(u, v)


def _with_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(comp, num, copies, sig, n, items): the shingle set of each class from one of its texts."""
    words = Words()
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            sets = [shingles(t, words) for t in part.column(4).to_pylist()]
            made = [*part.columns[:4], pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())]
            yield pa.record_batch(made, ["comp", "num", "copies", "sig", "n", "items"])


def _common_by_pair(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Common shingles of each pair, by search in the sorted sets; pairs are sorted by x."""
    both, at = np.zeros(len(x), np.int64), 0
    while at < len(x):
        end = at + int(np.searchsorted(x[at:], x[at], side="right"))
        own = sets[x[at]]
        for lo in range(at, end, 512):
            hi = min(end, lo + 512)
            others = [sets[k] for k in y[lo:hi]]
            joined = np.concatenate(others)
            where = np.minimum(np.searchsorted(own, joined), len(own) - 1)
            both[lo:hi] = np.add.reduceat((own[where] == joined).astype(np.int64), np.cumsum([0, *map(len, others[:-1])]))
        at = end
    return both


def _common_by_product(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common shingles of all pairs of two blocks, as a product of their incidence matrices, some columns at a time."""

    def cells(block: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of the block's shingles that are shared, by column."""
        items = np.concatenate([sets[k] for k in block])
        row = np.repeat(np.arange(len(block)), [len(sets[k]) for k in block])
        column = np.minimum(np.searchsorted(shared, items), len(shared) - 1)
        hit = shared[column] == items
        order = np.argsort(column[hit], kind="stable")
        return row[hit][order], column[hit][order]

    shared = np.intersect1d(*(np.unique(np.concatenate([sets[k] for k in side])) for side in (left, right)), assume_unique=True)
    out = np.zeros((len(left), len(right)))
    if not len(shared):
        return out
    (r1, c1), (r2, c2) = cells(left, shared), cells(right, shared)
    for lo in range(0, len(shared), COLUMNS):
        ends1, ends2 = np.searchsorted(c1, (lo, lo + COLUMNS)), np.searchsorted(c2, (lo, lo + COLUMNS))
        a, b = np.zeros((len(left), COLUMNS), np.float32), np.zeros((len(right), COLUMNS), np.float32)
        a[r1[slice(*ends1)], c1[slice(*ends1)] - lo] = 1
        b[r2[slice(*ends2)], c2[slice(*ends2)] - lo] = 1
        out += a @ b.T
    return out


def exact_links(sets: list[np.ndarray], sig: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two blocks whose Jaccard similarity is 0.8 or more, by their sets."""
    n = np.array([len(s) for s in sets])
    x, y = candidate_pairs(sig, n, left, right, same)
    if 20 * len(x) > len(left) * len(right) > 400:
        place = np.zeros(len(sets), np.int64)
        place[left] = np.arange(len(left))
        rows = place[x]
        place[right] = np.arange(len(right))
        both = _common_by_product(sets, left, right)[rows, place[y]].astype(np.int64)
    else:
        both = _common_by_pair(sets, x, y)
    good = 10 * both >= 8 * (n[x] + n[y] - both)
    return x[good], y[good]


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(num, root, links): for each class with a link in the job, the first of its component there and the documents it is linked to."""
    for job in _jobs(batches):
        left, right, same = _sides(job)
        if not len(left) or not len(right):
            continue
        sets = [np.frombuffer(s, np.uint64) for s in job["items"]]
        sig = np.frombuffer(b"".join(job["sig"]), np.uint16).reshape(-1, HASHES)
        copies = np.array(job["copies"])
        x, y = exact_links(sets, sig, left, right, same)
        if not len(x):
            continue
        links = np.bincount(x, copies[y], len(sets)) + np.bincount(y, copies[x], len(sets))
        label = _roots(len(sets), x, y)
        linked = np.nonzero(links)[0]
        num = np.array(job["num"])
        yield pa.record_batch([pa.array(num[linked]), pa.array(num[label[linked]]), pa.array(links[linked].astype(np.int64))], ["num", "root", "links"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(f"`{text_col}`").alias("text_hash"), F.col(f"`{text_col}`").alias("text"))


def _bounded(df: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A broadcast hint if the (materialised) table is small, else none."""
    return F.broadcast if df.count() <= BROADCAST_ROWS else (lambda x: x)


def candidate_ties(classes: DataFrame) -> DataFrame:
    """(node, component): classes (num, n, sig) tied by pairs that may reach the threshold; classes without a tie don't appear."""
    bucket = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(F.substring("sig", b * (2 * ROWS) + 1, F.lit(2 * ROWS)), b))
    bands = classes.select("num", F.explode(bucket).alias("bucket"))
    leaders = bands.groupBy("bucket").agg(F.min("num").alias("leader"), F.count("*").alias("members")).where("members > 1").select("bucket", "leader")
    met = materialise(bands.join(leaders, "bucket"))
    own, other = classes.select("num", "n", "sig"), classes.select(F.col("num").alias("leader"), F.col("n").alias("leader_n"), F.col("sig").alias("leader_sig"))
    pairs = met.where("num <> leader").select("num", "leader").distinct().join(own, "num").join(other, "leader")
    led = materialise(pairs.select("num", "n", "sig", "leader", "leader_n", "leader_sig").mapInArrow(_led, "u bigint, v bigint"))
    first = connected_components(led)
    known = first.select(F.col("node").alias("num"), "component")
    labelled = met.select("bucket", "num").join(known, "num", "left").select("bucket", "num", F.coalesce("component", "num").alias("tied"))
    several = labelled.groupBy("bucket").agg(F.min("tied").alias("a"), F.max("tied").alias("b")).where("a <> b").select("bucket")
    jobs = block_jobs(labelled.join(several, "bucket"), "bucket", BUCKET_BLOCK)
    second = _compared(jobs, own, 2 * HASHES + 40, _ties, "u bigint, v bigint")
    release(met, led)
    found = connected_components(first.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(second))
    release(first, second)
    return found


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, cls, n) of all documents, and (cls, class_id, class_hash, links) of all classes.

    class_id and class_hash name the document with the smallest id in the class's group; links counts documents of other classes.
    """
    keyed = _keyed(docs, id_col, text_col)
    made = T.StructType([T.StructField("doc_id", keyed.schema["doc_id"].dataType), *T._parse_datatype_string("text_hash bigint, cls binary, n bigint, sig binary").fields])
    signed = materialise(keyed.mapInArrow(_signed, made))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    classes = signed.where("cls IS NOT NULL").groupBy("cls").agg(first, F.count("*").alias("copies"), F.max("n").alias("n"), F.max("sig").alias("sig"))
    classes = materialise(classes.withColumn("num", F.monotonically_increasing_id()))  # written down, so a class keeps its number
    found = candidate_ties(classes)
    candidates = found.select(F.col("node").alias("num"), F.col("component").alias("comp"))
    chosen = materialise(candidates.join(classes.select("num", "first", "copies", "sig"), "num").select("comp", "num", "copies", "sig", F.col("first.doc_id").alias("r_id"), F.col("first.text_hash").alias("r_hash")))
    release(found)
    picked = chosen.select("num", "r_id", "r_hash")
    texts = keyed.join(_bounded(chosen)(picked), keyed["doc_id"].eqNullSafe(picked["r_id"]) & (keyed["text_hash"] == picked["r_hash"])).select("num", "text")
    texts = texts.join(chosen.select("num", "comp", "copies", "sig"), "num").select("comp", "num", "copies", "sig", "text")
    sets = materialise(texts.mapInArrow(_with_sets, "comp bigint, num bigint, copies bigint, sig binary, n bigint, items binary").dropDuplicates(["num"]))
    jobs = block_jobs(sets.select("comp", "num", "n"), "comp", BLOCK, "n")
    verified = _compared(jobs, sets.select("num", "copies", "sig", "items"), 2 * HASHES + 60, _verified, "num bigint, root bigint, links bigint", "n")
    groups = connected_components(verified.select(F.col("num").alias("u"), F.col("root").alias("v")))
    links = verified.groupBy("num").agg(F.sum("links").alias("links"))
    linked = materialise(groups.withColumnRenamed("node", "num").join(links, "num", "left").join(classes.select("num", "first"), "num"))
    release(chosen, sets, verified, groups)
    heads = linked.groupBy("component").agg(F.min("first").alias("head"))
    grouped = linked.join(heads, "component").select("num", "head", F.coalesce("links", F.lit(0)).alias("links"))
    every = classes.select("cls", "num", "first", "copies").join(grouped, "num", "left")
    head = F.coalesce("head", "first")
    result = every.select("cls", head.getField("doc_id").alias("class_id"), head.getField("text_hash").alias("class_hash"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"))
    return signed.select("doc_id", "text_hash", "cls", "n"), result


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, class_id (smallest id of its group), n_links (documents at similarity 0.8 or more), n_shingles."""
    rows, classes = similar_classes(docs, id_col, text_col)
    joined = rows.join(classes.withColumnRenamed("cls", "k"), F.col("cls") == F.col("k"), "left")
    return joined.select("doc_id", F.when(F.col("k").isNotNull(), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("links", F.lit(0).cast("bigint")).alias("n_links"), F.col("n").alias("n_shingles"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of similar ones: that with the smallest id.  Documents in no group stay."""
    rows, classes = similar_classes(docs, id_col, text_col)
    joined = rows.where("cls IS NOT NULL").join(classes.withColumnRenamed("cls", "k"), F.col("cls") == F.col("k"))
    is_head = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))
    key, digest, head, times = (unused_name(docs, x) for x in ("group_id", "group_hash", "group_head", "group_rows"))
    keys = joined.groupBy(F.col("doc_id").alias(key), F.col("text_hash").alias(digest)).agg(F.max(is_head).alias(head), F.count("*").alias(times))
    special = materialise(keys.where(~F.col(head) | (F.col(times) > 1)))
    hint = _bounded(special)
    gone, repeated = special.where(~F.col(head)), special.where(F.col(head))
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & (F.xxhash64(f"`{text_col}`") == F.col(digest))
    if repeated.isEmpty():
        return docs.join(hint(gone), same, "left_anti")
    once = docs.join(hint(repeated), same, "left_semi")
    return docs.join(hint(special), same, "left_anti").unionByName(once.dropDuplicates([id_col, text_col]))
