"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts become lower-cased words.  Over every run of 13 words the smallest hash of its 7-word grams is kept, on both sides: two equal runs have
the same smallest hash, so every shared span of 13 words is found (winnowing's guarantee, span = gram + window - 1).  Neighbouring runs mostly
share their fingerprint, so about a quarter of the positions remain as seeds.  A seed carries the words that it stands for and nothing else of its
text, so the work grows with the length of a text.  Seeds are joined with the benchmark's fingerprints; only where one matches are the 13-word runs
spelled out and compared as text.  Items of fewer than 13 words are runs of their own length.  Each text is read once: its number of words travels
as one more seed, which always matches.

What is broadcast is the benchmark's side, each table only where its bytes, which are counted first, are at most ``BROADCAST_BYTES``; beyond it the
join shuffles.  A passage that a third of all documents hold costs each of them a few rows; nothing is grouped by passage.

Defined results: null, empty or wordless text: no words, no hit, not contaminated; null item ids are not counted as items (their words still hit);
a very long text is held once by a task, with its seeds; hits of exactly a twentieth of the words contaminate; repeated rows and repeated ids: rows
are told apart by id and text, so each gets the result of its own text; an empty benchmark: no hits; no documents: no rows.  Only the named columns
are read, so others can have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from pairloom.llm.common import let, materialise, release, unused_name

#: Words in a run, and in a gram; a window holds SPAN - GRAM + 1 grams.
SPAN, GRAM = 13, 7
#: Bytes of a table of the benchmark's fingerprints, runs or items, or of contaminated rows, up to which it is broadcast.
BROADCAST_BYTES = 48 << 20
#: Values that the seeds of length 0 are spread over.
SALTS = 4096

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words before A-Z are lower-cased; the ends of words are the same as after.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(text, F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def _grams(lower: Column, size: int) -> Column:
    """Hash of every gram; empty if there are fewer words."""
    return F.when(
        F.size(lower) >= size,
        F.transform(F.sequence(F.lit(0), F.size(lower) - size), lambda i: F.xxhash64(*(F.get(lower, i + j) for j in range(size)))),
    ).otherwise(F.array().cast("array<bigint>"))


def _smallest(grams: Column, width: int) -> Column:
    """Smallest hash of every window of grams."""
    return F.when(
        F.size(grams) >= width,
        F.transform(F.sequence(F.lit(0), F.size(grams) - width), lambda i: F.least(*(F.get(grams, i + j) for j in range(width)))),
    ).otherwise(F.array().cast("array<bigint>"))


def _carried(words: Column, lo: Column, hi: Column, size: int) -> Column:
    """The words of the runs lo to hi, as one string (no word holds a space)."""
    return F.array_join(F.slice(words, lo + 1, hi - lo + size), " ").alias("words")


def _span_seeds(lower: Column, words: Column) -> Column:
    """Seeds of full runs: (fingerprint, words in a run, first run, last run, words) of each stretch of runs with one fingerprint."""

    def stretches(m: Column) -> Column:
        firsts = F.filter(F.transform(m, lambda x, i: F.when((i == 0) | (x != F.get(m, i - 1)), i)), lambda i: i.isNotNull())

        def seed(s: Column, i: Column, j: Column) -> Column:
            hi = F.coalesce(F.get(s, j + 1), F.size(m)) - 1
            return F.struct(F.get(m, i).alias("fp"), F.lit(SPAN).alias("len"), i.alias("lo"), hi.alias("hi"), _carried(words, i, hi, SPAN))

        return let(firsts, lambda s: F.transform(s, lambda i, j: seed(s, i, j)))

    return let(_grams(lower, GRAM), lambda g: let(_smallest(g, SPAN - GRAM + 1), stretches))


def _short_seeds(lower: Column, words: Column, size: int) -> Column:
    return F.transform(_grams(lower, size), lambda h, i: F.struct(h.alias("fp"), F.lit(size).alias("len"), i.alias("lo"), i.alias("hi"), _carried(words, i, i, size)))


def _seeds(words: Column, short: list[int], salt: Column) -> Column:
    """All seeds of a text, led by one of length 0 that holds its number of words (and a salt, as all texts have one)."""
    count = F.array(F.struct(salt.alias("fp"), F.lit(0).alias("len"), F.size(words).alias("lo"), F.size(words).alias("hi"), salt.cast("string").alias("words")))
    lower = F.transform(words, F.lower)
    return let(words, lambda w: let(lower, lambda low: F.concat(count, _span_seeds(low, w), *(_short_seeds(low, w, s) for s in short))))


def _runs(seed: str) -> Column:
    """(start, run) of the runs of a matched stretch; the seed of length 0 has one, its salt, that starts at the number of words."""
    own = F.split(F.translate(F.col(f"{seed}.words"), _UPPER, _LOWER), " ")
    spelled = let(own, lambda w: F.transform(
        F.sequence(F.lit(0), F.col(f"{seed}.hi") - F.col(f"{seed}.lo")),
        lambda j: F.struct((F.col(f"{seed}.lo") + j).alias("start"), F.array_join(F.slice(w, j + 1, F.greatest(F.col(f"{seed}.len"), F.lit(1))), " ").alias("run")),
    ))
    return F.explode(spelled)


def _small(df: DataFrame, size: Column) -> DataFrame:
    """With a broadcast hint if the (materialised) table's bytes are few."""
    total = df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    return F.broadcast(df) if total <= BROADCAST_BYTES else df


def benchmark_runs(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item, len, fp, run: the runs of all items, materialised (they are used more than once)."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("item"), words_of(F.col(f"`{text_col}`")).alias("words")).where(F.size("words") > 0)
    lower = F.transform(F.col("words"), F.lower)
    size, words = F.size("words"), F.col("words")
    short = _short_seeds(lower, words, 1)
    for s in range(2, SPAN):
        short = F.when(size == s, _short_seeds(lower, words, s)).otherwise(short)
    seeded = items.select("item", F.explode(F.when(size >= SPAN, let(lower, lambda low: _span_seeds(low, words))).otherwise(short)).alias("seed"))
    return materialise(seeded.select("item", F.col("seed.len").alias("len"), F.col("seed.fp").alias("fp"), _runs("seed").alias("r")).select("item", "len", "fp", F.col("r.run").alias("run")).distinct())


def _joined(a: DataFrame, b: DataFrame, how: str) -> DataFrame:
    """Two tables by id and text; ids may be null."""
    x, y = a.alias("a"), b.alias("b")
    return x.join(y, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")), how)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row per row of ``docs``: doc_id, text_hash, n_words, n_hit, n_items, items_sha256."""
    runs = benchmark_runs(benchmark, item_id_col, item_text_col)
    short = sorted(r["len"] for r in runs.where(F.col("len") < SPAN).select("len").distinct().collect())
    one = docs.sparkSession.range(SALTS).select(F.col("id").alias("fp"), F.lit(0).alias("len"), F.col("id").cast("string").alias("run"))
    prints = _small(materialise(runs.select("fp", "len").distinct().unionByName(one.select("fp", "len"))), F.lit(12))
    texts = _small(materialise(runs.select("run", "len").distinct().unionByName(one.select("run", "len"))), F.octet_length("run") + 12)
    owners = _small(materialise(runs.where(F.col("item").isNotNull()).select("run", "len", "item").distinct()), F.octet_length("run") + F.octet_length("item") + 16)
    text = F.col(f"`{text_col}`")
    words = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), words_of(text).alias("words"))
    seeds = words.select("doc_id", "text_hash", F.explode(_seeds(F.col("words"), short, F.pmod("text_hash", F.lit(SALTS)))).alias("seed"))
    met = seeds.join(prints, (F.col("seed.fp") == prints["fp"]) & (F.col("seed.len") == prints["len"])).select("doc_id", "text_hash", F.col("seed.len").alias("len"), _runs("seed").alias("r"))
    found = materialise(met.select("doc_id", "text_hash", "len", "r.start", "r.run").join(texts, ["run", "len"]).select("doc_id", "text_hash", "start", "len", "run"))
    release(runs, prints, texts)
    hits = found.where("len > 0")
    key = ["doc_id", "text_hash"]
    before = W.Window.partitionBy(*key).orderBy("start").rowsBetween(W.Window.unboundedPreceding, -1)
    spans = hits.groupBy(*key, "start").agg(F.max("len").alias("len"))
    covered = spans.withColumn("done", F.coalesce(F.max(F.col("start") + F.col("len")).over(before), F.lit(0)))
    n_hit = covered.groupBy(*key).agg(F.sum(F.greatest(F.lit(0), F.col("start") + F.col("len") - F.greatest("start", "done"))).cast("long").alias("n_hit"))
    items = hits.select(*key, "run", "len").distinct().join(owners, ["run", "len"]).groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed = F.coalesce(F.col("b.items"), F.array().cast("array<string>"))
    hit = _joined(n_hit, items, "left").select("a.doc_id", "a.text_hash", "a.n_hit", F.size(listed).cast("long").alias("n_items"), F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"))
    every = found.where("len = 0").select("doc_id", "text_hash", F.col("start").cast("long").alias("n_words"))
    return _joined(every, hit, "left").select(
        "a.doc_id", "a.text_hash", "a.n_words", F.coalesce("b.n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("b.n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("b.items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"),
    )


def contaminated() -> Column:
    """Whether hits are a twentieth of a text's words or more."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def with_contamination(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return contamination(docs, benchmark, **columns).drop("text_hash").withColumn("contaminated", contaminated())


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns: str) -> DataFrame:
    """``docs`` without the contaminated ones; all columns kept."""
    key, digest = unused_name(docs, "bad_id"), unused_name(docs, "bad_hash")
    bad = contamination(docs, benchmark, id_col, text_col, **columns).where(contaminated())
    bad = materialise(bad.select(F.col("doc_id").alias(key), F.col("text_hash").alias(digest)).distinct())
    id_bytes = F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + 24
    return docs.join(_small(bad, id_bytes), F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & (F.xxhash64(f"`{text_col}`") == F.col(digest)), "left_anti")
