"""Language identification by interpolated Kneser-Ney character models.

Training counts the highest-order character n-grams of the training rows, per language; lower orders are Kneser-Ney continuation counts and so follow
from the distinct n-grams of the next order.  Tasks add up their n-grams before anything is shuffled, and probabilities and back-off weights are
worked out by joins and sums over the tables of distinct n-grams, so no task and no driver holds a language's n-grams to make its model; none is
dropped.  A language's model is cut into pieces of about ``PIECE_ENTRIES`` entries by the last character, each a set of sorted arrays of n-gram
codes beside their log probabilities or weights.  Models of up to ``HELD_BYTES`` in all are broadcast; beyond that a worker reads the pieces it needs
from the shared folder, one at a time for each chunk of text, so what it holds doesn't grow with the model.

Scoring looks each distinct n-gram of a chunk of texts up by binary search, backs off where it is unseen and takes the language of lowest
cross-entropy per character.  A tenth of the training texts, chosen by their hashes, is kept out of the counts and only used for calibration (each
different text once): a text whose cross-entropy is far beyond what texts of that language have by mean and deviation is flagged as rejected.  A
language that would be left without counted texts counts them all.

Texts are lower-cased; everything that isn't a letter becomes one space.  Defined results: null texts and texts without letters: ``und``, score
0; ties: the first language by name; rows with a null language aren't learned from; no training rows: ``und`` for all; repeated rows count as often
in training as they are there, and get equal results; a very long text is scored whole and held once; an empty table gives an empty table.  Only the
named columns are read; a column of the result's name leads to another name.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import materialise, release, unused_name
from pairloom.sources.stores import file_system

ORDER, DISCOUNT = 4, 0.75
#: Bits of a character's code; ORDER of them fill an unsigned 64-bit number.
BITS = 16
MASK = np.uint64((1 << BITS) - 1)
#: Characters that are counted or scored at once; entries of a piece of a model; bytes of all models up to which they are broadcast.
CHUNK, PIECE_ENTRIES, HELD_BYTES = 4_000_000, 2_000_000, 256_000_000
#: One training text in so many is kept for calibration.
CALIBRATION_SHARE = 10
#: Characters that a text needs to be calibrated on, texts that a language needs, and its least deviation.
CALIBRATION_CHARS, CALIBRATION_TEXTS, LEAST_DEVIATION = 20, 5, 0.05
_OTHER = re.compile(r"[\W\d_]+")


def codes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all texts, each led by ORDER - 1 spaces, and where each begins.

    A character's code is its code point; those beyond 16 bits share the private area, where no letters are.
    """
    lead = " " * (ORDER - 1)
    parts = [lead + _OTHER.sub(" ", t.lower()).strip() + " " if t else "" for t in texts]
    joined = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
    if len(joined) and joined.max() >= 1 << BITS:
        joined = np.where(joined >= 1 << BITS, 0xE000 + joined % 6400, joined)
    return joined.astype(np.uint64), np.cumsum([0, *map(len, parts)])


def grams_of(codes: np.ndarray, n: int) -> np.ndarray:
    """Number of the n-gram that ends at each position (positions before the n-th hold what there is)."""
    key = codes.copy()
    for back in range(1, n):
        key[back:] |= codes[:-back] << np.uint64(BITS * back)
    return key


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of a task; given out whenever the table is large."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([k for k, _ in held[lang]])
        numbers = np.concatenate([n for _, n in held[lang]])
        unique, at = np.unique(keys, return_inverse=True)
        return unique, np.bincount(at, numbers, len(unique)).astype(np.int64)

    def add(lang: str, texts: list[str]) -> None:
        codes, starts = codes_of(texts)
        if not len(codes):
            return
        keys = grams_of(codes, ORDER)
        scored = np.ones(len(keys), bool)
        for back in range(ORDER - 1):
            scored[np.minimum(starts[:-1] + back, len(keys) - 1)] = False
        unique, n = np.unique(keys[scored], return_counts=True)
        own = held.setdefault(lang, [])
        own.append((unique, n))
        if len(own) >= 8:
            held[lang] = [merged(lang)]

    def out() -> Iterator[pa.RecordBatch]:
        for lang in list(held):
            k, n = merged(lang)
            yield pa.record_batch([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            del held[lang]

    for batch in batches:
        waiting: dict[str, list] = {}
        size: dict[str, int] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            waiting.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= CHUNK:
                add(lang, waiting.pop(lang))
                size[lang] = 0
        for lang, texts in waiting.items():
            add(lang, texts)
        if sum(len(k) for own in held.values() for k, _ in own) > 2_000_000:
            yield from out()
    yield from out()


#: What an entry of a model is: the log probability of an n-gram (by n), the log weight of a context (CONTEXT + its length), or that of any unseen
#: character.
CONTEXT, UNSEEN = 10, 20


def _low(gram: Column, n: int) -> Column:
    """The last n characters."""
    return gram.bitwiseAND(F.lit((1 << (BITS * n)) - 1))


def model_entries(counts: DataFrame) -> DataFrame:
    """(lang, kind, key, value) of all languages, from counts (lang, gram, n) of the highest order."""
    spark = counts.sparkSession
    alphabet = counts.select(_low(F.col("gram"), 1)).distinct().count() + 1  # and one for what is unseen
    levels = {ORDER: counts.select("lang", "gram", F.col("n").cast("double").alias("n"))}
    for n in range(ORDER - 1, 0, -1):  # continuation counts: distinct characters before
        levels[n] = materialise(levels[n + 1].groupBy("lang", _low(F.col("gram"), n).alias("gram")).agg(F.count("*").cast("double").alias("n")))
    parts, below = [], None
    for n in range(1, ORDER + 1):
        level = levels[n].withColumn("context", F.shiftrightunsigned("gram", BITS))
        weights = level.groupBy("lang", "context").agg(F.sum("n").alias("total"), (DISCOUNT * F.count("*") / F.sum("n")).alias("weight"))
        joined = level.join(weights, ["lang", "context"])
        if below is None:
            joined = joined.withColumn("base", F.lit(1.0 / alphabet))
            parts.append(weights.select("lang", F.lit(UNSEEN).alias("kind"), F.col("context").alias("key"), F.ln(F.col("weight") / alphabet).alias("value")))
        else:
            joined = joined.withColumn("low", _low(F.col("gram"), n - 1)).join(below, ["lang", "low"])
            parts.append(weights.select("lang", F.lit(CONTEXT + n - 1).alias("kind"), F.col("context").alias("key"), F.ln("weight").alias("value")))
        p = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total") + F.col("weight") * F.col("base")
        own = materialise(joined.select("lang", "gram", p.alias("p")))
        parts.append(own.select("lang", F.lit(n).alias("kind"), F.col("gram").alias("key"), F.ln("p").alias("value")))
        below = own.select("lang", F.col("gram").alias("low"), F.col("p").alias("base"))
    entries = spark.createDataFrame([], "lang string, kind int, key bigint, value double")
    for x in parts:
        entries = entries.unionByName(x)
    return entries


class Piece:
    """A part of a language's model: for each kind of entry the sorted codes and their values."""

    def __init__(self, body: bytes | None):
        self.of: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if body is None:  # no character falls to this piece
            return
        table = pa.ipc.open_file(io.BytesIO(body)).read_all()
        kind = table.column("kind").to_numpy()
        keys, values = table.column("key").to_numpy().view(np.uint64), table.column("value").to_numpy()
        self.of = {int(k): (keys[kind == k], values[kind == k]) for k in np.unique(kind)}

    def find(self, kind: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys are there, and the values of those that are."""
        own, values = self.of.get(kind, (np.empty(0, np.uint64), np.empty(0)))
        if not len(own):
            return np.zeros(len(keys), bool), np.empty(0)
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        hit = own[at] == keys
        return hit, values[at[hit]]


def _packed(group: pa.Table) -> pa.Table:
    """A piece's entries as one row (lang, piece, body)."""
    kind, key = group.column("kind").to_numpy(), group.column("key").to_numpy().view(np.uint64)
    order = np.lexsort((key, kind))
    sorted_ = pa.table([kind[order], key[order].view(np.int64), group.column("value").to_numpy()[order].astype(np.float32)], ["kind", "key", "value"])
    out = io.BytesIO()
    with pa.ipc.new_file(out, sorted_.schema) as file:
        file.write_table(sorted_)
    return pa.table([pa.array([group.column("lang")[0].as_py()]), pa.array([group.column("piece")[0].as_py()], pa.int32()), pa.array([out.getvalue()], pa.binary())], ["lang", "piece", "body"])


@dataclass
class Model:
    """Languages with the number of their models' pieces; the pieces themselves, or the folder that they are read from; what calibration found."""

    langs: list[str]
    pieces: list[int]
    folder: str
    held: dict[tuple[str, int], bytes] | None = None
    mean: np.ndarray | None = None
    deviation: np.ndarray | None = None
    open: dict[tuple[str, int], Piece] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"open": {}}

    def piece(self, lang: str, k: int) -> Piece:
        if self.held is None:
            store, path = file_system(self.folder)
            rows = ds.dataset(path, filesystem=store, format="parquet").to_table(columns=["body"], filter=(ds.field("lang") == lang) & (ds.field("piece") == k))
            return Piece(rows.column("body")[0].as_py() if rows.num_rows else None)
        if (lang, k) not in self.open:
            self.open[lang, k] = Piece(self.held.get((lang, k)))
        return self.open[lang, k]


def _language_log(model: Model, j: int, keys: np.ndarray) -> np.ndarray:
    """Log probability of each n-gram's last character in one language."""
    pieces = model.pieces[j]
    value, level = np.zeros(len(keys)), np.zeros(len(keys), np.int8)
    backoff, unseen = np.zeros((ORDER, len(keys))), 0.0
    last, before = keys & MASK, (keys >> np.uint64(BITS)) & MASK
    for k in range(pieces):
        piece = model.piece(model.langs[j], k)
        if UNSEEN in piece.of:
            unseen = float(piece.of[UNSEEN][1][0])
        rest = np.nonzero(last % np.uint64(pieces) == k)[0] if pieces > 1 else np.arange(len(keys))
        for n in range(ORDER, 0, -1):
            hit, values = piece.find(n, keys[rest] & np.uint64((1 << (BITS * n)) - 1))
            value[rest[hit]], level[rest[hit]] = values, n
            rest = rest[~hit]
            if not len(rest):
                break
        # weights of the contexts, which end with the character before; only those of n-grams that aren't known whole are needed
        rest = np.nonzero(before % np.uint64(pieces) == k)[0] if pieces > 1 else np.nonzero(level < ORDER)[0]
        for n in range(1, ORDER):
            hit, values = piece.find(CONTEXT + n, (keys[rest] >> np.uint64(BITS)) & np.uint64((1 << (BITS * n)) - 1))
            backoff[n, rest[hit]] = values
    value[level == 0] = unseen
    for n in range(1, ORDER):
        value += np.where(level <= n, backoff[n], 0.0)
    return value


def log_probabilities(model: Model, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities of the distinct n-grams, a column per language, and the n-gram at each position."""
    distinct, back = np.unique(grams_of(codes, ORDER), return_inverse=True)  # far fewer than positions, and sorted: look-ups are cheap
    return np.stack([_language_log(model, j, distinct) for j in range(len(model.langs))], axis=1), back


def entropies(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character in every language, and the scored characters of each text."""
    size = len(model.langs)
    result, length = np.zeros((len(texts), size)), np.zeros(len(texts), np.int64)
    first = 0
    while first < len(texts):
        last, chars = first, 0
        while last < len(texts) and (last == first or chars < CHUNK):
            chars += len(texts[last] or "")
            last += 1
        codes, starts = codes_of(texts[first:last])
        if len(codes):
            logp, back = log_probabilities(model, codes)
            lead = np.zeros(len(codes), bool)
            begun = starts[:-1][np.diff(starts) > 0]
            for k in range(ORDER - 1):
                lead[np.minimum(begun + k, len(codes) - 1)] = True
            for j in range(size):
                column = logp[:, j][back]
                column[lead] = 0
                run = np.concatenate([[0.0], np.cumsum(column)])
                result[first:last, j] = -(run[starts[1:]] - run[starts[:-1]])
            length[first:last] = np.maximum(np.diff(starts) - (ORDER - 1), 0)
        first = last
    return result / np.maximum(length, 1)[:, None], length


def _calibrate(model: Model, rows: DataFrame) -> None:
    """Mean and deviation of each language's cross-entropy over different texts (text, lang); a row per language reaches the driver."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = {x: j for j, x in enumerate(sent.value.langs)}
        for batch in batches:
            ce, length = entropies(sent.value, batch.column(0).to_pylist())
            at = np.array([langs[x] for x in batch.column(1).to_pylist()], np.int64)
            own, long = ce[np.arange(len(at)), at], length >= CALIBRATION_CHARS
            yield pa.record_batch([batch.column(1).cast(pa.string()), batch.column(2), pa.array(np.where(long, own, np.nan), from_pandas=True)], ["lang", "digest", "own"])

    each = rows.mapInArrow(measured, "lang string, digest bigint, own double").groupBy("lang", "digest").agg(F.min("own").alias("own"))
    found = {r["lang"]: r for r in each.groupBy("lang").agg(F.count("own").alias("n"), F.avg("own").alias("mean"), F.stddev_pop("own").alias("deviation")).collect()}
    sent.unpersist()
    known = [r for r in found.values() if r["n"]]
    overall = sum(r["mean"] * r["n"] for r in known) / sum(r["n"] for r in known) if known else 3.0
    model.mean, model.deviation = np.full(len(model.langs), overall), np.ones(len(model.langs))
    for j, lang in enumerate(model.langs):
        if lang in found and found[lang]["n"] >= CALIBRATION_TEXTS:
            model.mean[j], model.deviation[j] = found[lang]["mean"], max(found[lang]["deviation"], LEAST_DEVIATION)


def model_of(counts: DataFrame) -> Model | None:
    """The models of all languages of counts (lang, gram, n), not yet calibrated."""
    entries = materialise(model_entries(counts))
    sizes = entries.groupBy("lang").agg(F.ceil(F.count("*") / PIECE_ENTRIES).cast("int").alias("pieces"), F.count("*").alias("n"))
    found = sorted((r["lang"], r["pieces"], r["n"]) for r in sizes.collect())
    if not found:
        return None
    cut = entries.join(sizes.select("lang", "pieces"), "lang").withColumn("piece", F.pmod(_low(F.col("key"), 1), F.col("pieces")).cast("int"))
    packed = materialise(cut.select("lang", "piece", "kind", "key", "value").groupBy("lang", "piece").applyInArrow(_packed, "lang string, piece int, body binary"))
    release(entries)
    model = Model([x for x, _, _ in found], [n for _, n, _ in found], packed._materialised_at)
    if 16 * sum(n for _, _, n in found) <= HELD_BYTES:
        model.held = {(r["lang"], r["piece"]): bytes(r["body"]) for r in packed.collect()}
        release(packed)
    return model


def learn(training: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Models from all rows with a text and a language, and all their n-grams."""
    text, lang = F.col(f"`{text_col}`"), F.col(f"`{lang_col}`").cast("string")
    rows = training.where(lang.isNotNull() & text.isNotNull()).select(text.alias("text"), lang.alias("lang"), F.xxhash64(text).alias("digest"))
    kept = F.pmod(F.xxhash64(F.col("digest")), F.lit(CALIBRATION_SHARE)) == 0
    alone = materialise(rows.groupBy("lang").agg(F.count_if(~kept).alias("counted")).where("counted = 0").select(F.col("lang").alias("alone")))
    flagged = rows.withColumn("kept", kept)
    if not alone.isEmpty():
        flagged = rows.join(alone, rows["lang"] == alone["alone"], "left").withColumn("kept", kept & F.col("alone").isNull())
    counts = materialise(flagged.where(~F.col("kept")).select("text", "lang").mapInArrow(_counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    model = model_of(counts)
    release(counts)
    if model is not None:
        _calibrate(model, flagged.where("kept").select("text", "lang", "digest"))
    return model


def predict(model: Model | None, texts: list[str | None], reject_at: float = 6.0) -> tuple[list[str], list[float], list[bool]]:
    if model is None:
        return ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
    ce, length = entropies(model, texts)
    has = [bool(t) and any(c.isalpha() for c in t) for t in texts]
    best = ce.argmin(axis=1)
    odds = np.exp(-np.minimum((ce - ce.min(axis=1, keepdims=True)) * np.minimum(length, 60)[:, None], 50))
    score = 1 / odds.sum(axis=1)
    far = ce[np.arange(len(texts)), best] > (model.mean + reject_at * model.deviation)[best]
    langs = [model.langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
    return langs, [float(s) if h else 0.0 for s, h in zip(score, has, strict=True)], [bool(f) or not h for f, h in zip(far, has, strict=True)]


def with_language(docs: DataFrame, model: Model | None, text_col: str = "text", out: str | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a struct (lang, score, rejected); narrow.  Returns the frame and the struct's name."""
    out = out or unused_name(docs, "language")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def predicted(text: pa.Array) -> pa.Array:
        lang, score, rejected = predict(sent.value, text.to_pylist())
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["lang", "score", "rejected"])

    predicted.__annotations__ = {"text": pa.Array, "return": pa.Array}
    udf = F.arrow_udf(predicted, "struct<lang:string,score:double,rejected:boolean>").asNondeterministic()
    return docs.withColumn(out, udf(F.col(text_col))), out
