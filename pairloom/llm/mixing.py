"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are put in a fixed random order and cut into blocks of ``block_bytes``.  Time is divided into slots of one block.  The
target is the fluid mixture: at any time the sources that aren't used up there share a slot by their weights.  A block is released in the slot in
which the fluid mixture begins it and needs to be placed by the end of the slot in which that ends it; of the released blocks the one with the
earliest deadline goes first.  Releases and deadlines are exact (whole-number arithmetic on the weights as given) over the whole horizon, so every
source's share of any prefix differs from its target by less than one block, however long.  Nothing is dropped or repeated.

The schedule is worked out slot by slot on the driver, from the number of blocks of each source and never from rows, with memory for the sources
only; it is written to the shared folder by chunks, as a table with a row per block.  Where blocks aren't given a size they have ``BLOCK_BYTES``, or as
many more as keep the schedule within ``MAX_SLOTS`` slots.

Places are worked out on a narrow table with a row per different (source, id, text): its hash, bytes and copies.  Such rows go to buckets by their
hash, buckets are summed, and positions are counted within buckets only; blocks then meet their slots in a join.  The documents are joined with
their places once, by the hash; their texts take part in no window.

Defined results: null sources are one source of their own (named ''); null and empty texts count one byte; a very long text begins in one block and
reaches over the slots of those it fills, which stay its source's; sources without a weight get that of the smallest weighted one; ties of the
schedule go by name; equal rows are spread over the range of bytes that they have together; an empty table gives an empty result.  Columns of the
new names in ``docs`` are kept, and the new ones are then led by underscores.  Any number of sources will do: the driver holds a name and a few
numbers of each, and what is broadcast are sources of several buckets only.
"""

from __future__ import annotations

import heapq
import math
import uuid
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairloom.llm.common import materialise, release, shared_dir, unused_name
from pairloom.session import remove

#: Least bytes of a block, slots of a schedule at most where the size of blocks isn't given, and rows of the narrow table in a bucket.
BLOCK_BYTES, MAX_SLOTS, BUCKET_ROWS = 65_536, 4_000_000, 2_000
#: Slots of the schedule that are written at once.
CHUNK_SLOTS = 500_000


def fluid_slots(blocks: dict[str, int], weights: dict[str, float]) -> Iterator[tuple[str, int]]:
    """(source, block) slot by slot: earliest deadline first among released blocks (ties by name)."""
    names = sorted(s for s, n in blocks.items() if n > 0)
    exact = [Fraction(weights[s]) for s in names]
    unit = math.lcm(*(w.denominator for w in exact))
    n, w = [blocks[s] for s in names], [int(x * unit) for x in exact]
    # sources by when the fluid mixture uses them up; before the k-th end, done[k] blocks are of used up sources and the others weigh rest[k]
    ends = sorted(range(len(names)), key=lambda k: Fraction(n[k], w[k]))
    done = [0, *accumulate(n[k] for k in ends)]
    rest = [*accumulate((w[k] for k in reversed(ends)))][::-1]
    at = [0] * len(names)  # the next end of any source, as each source's blocks see it
    placed = [0] * len(names)

    def ended(k: int) -> tuple[int, int]:
        """The slot in which the source's next block ends, and the one in which the block after that begins."""
        i = placed[k] + 1
        if i * w[ends[at[k]]] > n[ends[at[k]]] * w[k]:
            at[k] = bisect_left(range(len(ends)), True, lo=at[k] + 1, key=lambda e: i * w[ends[e]] <= n[ends[e]] * w[k])
        whole, part = divmod(i * rest[at[k]], w[k])
        return done[at[k]] + whole + (part > 0), done[at[k]] + whole

    released = [(*ended(k), k) for k in range(len(names))]  # (deadline, release of the block after it, source)
    heapq.heapify(released)
    waiting: list[tuple[int, int]] = []
    for now in range(sum(n)):
        while waiting and waiting[0][0] <= now:
            _, k = heapq.heappop(waiting)
            heapq.heappush(released, (*ended(k), k))
        _, after, k = heapq.heappop(released)
        yield names[k], placed[k]
        placed[k] += 1
        if placed[k] < n[k]:
            heapq.heappush(waiting, (after, k))


def slot_table(spark: SparkSession, blocks: dict[str, int], weights: dict[str, float]) -> tuple[DataFrame, str]:
    """The schedule (slot_source, slot_block, slot), written by chunks to the shared folder, and where."""
    path, slots, start = f"{shared_dir(spark)}/pairloom-{uuid.uuid4().hex}", fluid_slots(blocks, weights), 0
    while (chunk := [*islice(slots, CHUNK_SLOTS)]) or not start:
        columns = [pa.array([s for s, _ in chunk], "string"), pa.array([k for _, k in chunk], "int64"), pa.array(range(start, start + len(chunk)), "int64")]
        spark.createDataFrame(pa.table(columns, ["slot_source", "slot_block", "slot"])).write.mode("append").parquet(path)
        if not chunk:
            break
        start += len(chunk)
    return spark.read.schema("slot_source string, slot_block bigint, slot bigint").parquet(path), path


def places(groups: DataFrame, slots: DataFrame, block_bytes: int, parts: DataFrame) -> DataFrame:
    """Where each row (key, origin, n_bytes, copies) of the narrow table begins: its start, and the block and slot of that."""
    keyed = groups.join(F.broadcast(parts), groups["origin"] == parts["part_source"], "left")
    # the bucket follows the hash's order, so positions by (bucket, hash) are positions by hash
    where = F.floor((F.shiftrightunsigned("key", 33) * F.coalesce("part_count", F.lit(1))) / F.lit(1 << 31)).cast("bigint")
    keyed = keyed.select("key", "origin", "n_bytes", "copies", where.alias("bucket"))
    sums = keyed.groupBy("origin", "bucket").agg(F.sum("n_bytes").alias("total"))
    before = Window.partitionBy("origin").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row per bucket
    offsets = sums.select(F.col("origin").alias("o"), F.col("bucket").alias("b"), F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("origin", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    within = keyed.withColumn("ahead", F.coalesce(F.sum("n_bytes").over(inside), F.lit(0)))
    begun = within.join(offsets, (F.col("origin") == F.col("o")) & (F.col("bucket") == F.col("b"))).withColumn("start", F.col("offset") + F.col("ahead"))
    begun = begun.withColumn("block", F.floor(F.col("start") / F.lit(block_bytes)).cast("bigint"))
    met = begun.join(slots, (F.col("origin") == F.col("slot_source")) & (F.col("block") == F.col("slot_block")))
    return met.select("key", "origin", "n_bytes", "copies", "start", "block", "slot")


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", block_bytes: int | None = None, power: float = 0.5) -> DataFrame:
    """``docs`` with mix_slot (the slot of its block), mix_block (the block of its source) and mix_start (its place in the source, in bytes).

    Reading by (mix_slot, mix_start) gives the mixture.  Without weights a source's weight is its size to the ``power``.
    """
    spark = docs.sparkSession
    slot, block, start, key, origin, size = (unused_name(docs, n) for n in ("mix_slot", "mix_block", "mix_start", "mix_key", "mix_origin", "mix_bytes"))
    text = F.col(f"`{text_col}`")
    source = F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit(""))
    keyed = docs.withColumns({
        origin: source,
        key: F.xxhash64(source, F.col(f"`{id_col}`"), text),
        size: F.greatest(F.coalesce(F.octet_length(text), F.lit(1)), F.lit(1)).cast("bigint"),
    })
    groups = materialise(keyed.groupBy(F.col(key).alias("key"), F.col(origin).alias("origin")).agg(F.sum(size).alias("n_bytes"), F.count("*").alias("copies")))
    sizes = groups.groupBy("origin").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows")).collect()
    if block_bytes is None:
        block_bytes = max(BLOCK_BYTES, -(-sum(r["bytes"] for r in sizes) // MAX_SLOTS))
    blocks = {r["origin"]: -(-r["bytes"] // block_bytes) for r in sizes}
    if weights is None:
        weights = {r["origin"]: r["bytes"] ** power for r in sizes}
    least = min((w for w in weights.values() if w > 0), default=1.0)
    weights = {s: weights[s] if weights.get(s, 0) > 0 else least for s in blocks}
    slots, slots_at = slot_table(spark, blocks, weights)
    # sources of several buckets, of which there are fewer than rows by BUCKET_ROWS; the others have one
    several = sorted((r["origin"], r["rows"] // BUCKET_ROWS) for r in sizes if r["rows"] >= 2 * BUCKET_ROWS)
    # from Arrow, as a list of rows would start Python workers, of a kind that the executors keep beside those of the other stages
    parts = pa.table([pa.array([s for s, _ in several], "string"), pa.array([k for _, k in several], "int64")], ["part_source", "part_count"])
    placed = materialise(places(groups, slots, block_bytes, spark.createDataFrame(parts)))
    release(groups)
    names = {x: unused_name(keyed, f"mix_at_{x}") for x in placed.columns}
    c = {x: F.col(name) for x, name in names.items()}
    own = [F.col(f"`{x}`") for x in docs.columns]
    joined = keyed.join(placed.withColumnsRenamed(names), F.col(key) == c["key"])
    long = placed.where((F.col("copies") > 1) & (F.floor((F.col("start") + F.col("n_bytes") - 1) / block_bytes) > F.col("block")))
    if long.isEmpty():
        remove(spark, slots_at)
        return joined.select(*own, c["slot"].alias(slot), c["block"].alias(block), c["start"].alias(start))
    # equal rows of more than a block: each takes one of their places by chance and its slot by its own block; what chance gave is written down
    turn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), c["copies"])
    begun = joined.select(*own, origin, (c["start"] + F.floor(turn * c["n_bytes"] / c["copies"]).cast("bigint")).alias(start))
    begun = materialise(begun.withColumn(block, F.floor(F.col(start) / F.lit(block_bytes)).cast("bigint")))
    names = {x: unused_name(begun, f"mix_{x}") for x in slots.columns}
    met = begun.join(slots.withColumnsRenamed(names), (F.col(origin) == F.col(names["slot_source"])) & (F.col(block) == F.col(names["slot_block"])))
    return met.select(*own, F.col(names["slot"]).alias(slot), F.col(block), F.col(start))


def in_order(mixture: DataFrame, partitions: int) -> DataFrame:
    """The mixture sorted for reading: by ranges of slots, and within each."""
    return mixture.repartitionByRange(partitions, "mix_slot", "mix_start").sortWithinPartitions("mix_slot", "mix_start")
