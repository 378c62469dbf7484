"""Toxicity from a learned lexicon, matched through a trie and a Levenshtein automaton, with context windows.

Learning (labelled rows only): for each word the toxic and the clean documents that hold it are counted over all rows given.  A word enters
the lexicon with its smoothed precision if the likelihood ratio against the overall share of toxic holders is beyond what the number of words
tried would give by chance.  Copied texts are no independent evidence: a word has at most as many toxic holders as it has different neighbours
in toxic texts.  Words near a term that clean documents hold are remembered as no misspellings of it.  Lexicon and exceptions are words of the rows
given, so a bound on those bounds the model.

Scoring: each distinct word is looked up once per worker.  A word is tried as it stands, with digits and signs read as the letters that they look
like, and with long runs of one letter shortened; single letters in a row are tried as one word.  A term within one edit (a letter more, less or
other, or two neighbours swapped; terms of ``FUZZY_LENGTH`` letters or more), or within two (no swaps; ``LONG_LENGTH`` or more), is found by walking
the lexicon's trie together with the rows of the Levenshtein automaton of the word; a word that has no half, or no third, of a term where it would
then be is skipped.  A disguised or misspelled hit counts less than an exact one.  What stands around a hit tells quotation from abuse: a pair of
quotation marks on its line that encloses it, and words of reporting among the ``WINDOW`` words before it, lower it.  Hits combine as independent
evidence.

Defined results: null, empty and wordless texts score 0; repeated rows score alike; equally near terms: the strongest, then the first by letters;
no labelled rows or no toxic label: an empty lexicon and scores of 0; rows with a null label are not learned from; a very long text is scored whole
and held once; an empty table gives an empty table.  Only the named columns are read; a column of the result's name leads to another name.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import materialise, release, unused_name

#: Words with the digits and signs inside them, quotation marks, and ends of lines.
_WORD = re.compile(r"(?:[@$](?=[^\W\d_]))?[^\W_]+(?:[@$!*]+[^\W_]+)*|[\"“”«»„\n]")
_PART = re.compile(r"[^\W_]+")
#: What closes an opening quotation mark; the straight mark opens and closes.
_CLOSES = {'"': '"', "“": "”", "„": "“", "«": "»", "»": "«"}
_MARKS = frozenset("\"“”«»„")
#: Letters that digits and signs stand for.
_LOOKS = str.maketrans("013457@$!", "oieastasi")
_RUN = re.compile(r"(.)\1{2,}")
#: Words that report what others said.
_REPORTING = frozenset("quote quoted quotes quoting said says saying wrote writes called reported cited term word zitat sagte schrieb nannte dit écrit appelé citation dijo escribió llamó cita".split())
WINDOW = 6
#: Share of a hit's weight that is left within quotation marks and beside words of reporting, and for a disguise, one edit and two.
QUOTED, REPORTED, DISGUISED, MISSPELLED, MANGLED = 0.35, 0.8, 0.9, 0.6, 0.3
#: Shortest terms that may be matched with one edit and with two; single letters that make a word; entries of a worker's table of words.
FUZZY_LENGTH, LONG_LENGTH, SPELLED, TABLE_ROWS = 5, 10, 4, 1_000_000


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def forms_of(word: str) -> list[str]:
    """What a word may stand for besides itself: letters for digits and signs, and runs of a letter shortened."""
    out: list[str] = []
    plain = word
    if not word.isalpha():
        plain = word.translate(_LOOKS) if any(c.isalpha() for c in word) else word
    if _RUN.search(plain) is None:
        return out if plain == word else [plain]
    for x in (plain, _RUN.sub(r"\1", plain), _RUN.sub(r"\1\1", plain)):
        if x != word and x not in out:
            out.append(x)
    return out


@dataclass(frozen=True)
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()


class Trie:
    """Terms by letters; ``near`` walks it with the automaton's rows."""

    def __init__(self, terms: dict[str, float], exceptions: frozenset[str] = frozenset()):
        self.terms, self.exceptions = terms, exceptions
        self.root: dict = {}
        self.long: dict = {}
        self.heads: set[str] = set()
        self.tails: set[str] = set()
        #: The letters of each term in order, which a swap leaves as they are.
        self.letters: set[str] = set()
        #: Thirds of long terms: the first, the last, and the middle ones by where they begin.
        self.first: set[str] = set()
        self.last: set[str] = set()
        self.middle: set[tuple[int, str]] = set()
        for term in terms:
            if len(term) < FUZZY_LENGTH:
                continue
            self._add(self.root, term)
            half = len(term) // 2
            self.heads.add(term[:half])
            self.tails.add(term[half:])
            self.letters.add("".join(sorted(term)))
            if len(term) >= LONG_LENGTH:
                self._add(self.long, term)
                a, b = len(term) // 3, 2 * len(term) // 3
                self.first.add(term[:a])
                self.last.add(term[b:])
                self.middle.add((a, term[a:b]))
        self.sizes = [sorted({len(x) for x in own}) for own in (self.heads, self.tails, self.first, self.last)]
        self.spans = sorted({(a, len(x)) for a, x in self.middle})

    @staticmethod
    def _add(node: dict, term: str) -> None:
        for c in term:
            node = node.setdefault(c, {})
        node[""] = term

    def _may_be_one(self, word: str) -> bool:
        """One edit leaves one half of the term as it is; a swap of neighbours may touch both, but keeps the letters."""
        if any(word[:n] in self.heads for n in self.sizes[0]) or any(word[-n:] in self.tails for n in self.sizes[1]):
            return True
        return "".join(sorted(word)) in self.letters

    def _may_be_two(self, word: str) -> bool:
        """Two edits leave one third of the term as it is, at most two places from where it was."""
        if any(word[:n] in self.first for n in self.sizes[2]) or any(word[-n:] in self.last for n in self.sizes[3]):
            return True
        return any((a, word[k : k + n]) in self.middle for a, n in self.spans for k in range(max(0, a - 2), a + 3))

    def near(self, word: str) -> tuple[str, int] | None:
        """The nearest term and its distance, 1 or 2 (the word itself isn't a term)."""
        if len(word) < FUZZY_LENGTH - 1 or word in self.exceptions:
            return None
        found = set(self._walk(self.root, word, 0, 1, True)) if self._may_be_one(word) else ()
        edits = 1
        if not found and len(word) >= LONG_LENGTH - 2 and self._may_be_two(word):
            found, edits = set(self._walk(self.long, word, 0, 2, False)), 2
        return min(((t, edits) for t in found), key=lambda x: (-self.terms[x[0]], x[0]), default=None)

    def _walk(self, node: dict, word: str, i: int, edits: int, swaps: bool) -> Iterator[str]:
        """States of the automaton: position in the word and edits left; edges: the trie's letters."""
        if "" in node and len(word) - i <= edits:
            yield node[""]
        if i < len(word) and (then := node.get(word[i])) is not None:
            yield from self._walk(then, word, i + 1, edits, swaps)
        if edits:
            if i < len(word):
                yield from self._walk(node, word, i + 1, edits - 1, swaps)
            if swaps and i + 1 < len(word) and word[i] != word[i + 1] and (then := node.get(word[i + 1], {}).get(word[i])) is not None:
                yield from self._walk(then, word, i + 2, edits - 1, swaps)
            for c, then in node.items():
                if c:
                    yield from self._walk(then, word, i, edits - 1, swaps)
                    if i < len(word) and c != word[i]:
                        yield from self._walk(then, word, i + 1, edits - 1, swaps)


def quoted(words: list[str]) -> list[bool]:
    """Whether each word lies between a pair of quotation marks on its line; marks that aren't closed there enclose nothing."""
    out = [False] * len(words)
    waiting: list[tuple[str, int]] = []  # the mark that closes, and where its partner stands
    for i, w in enumerate(words):
        if w == "\n":
            waiting = []
        elif w in _MARKS:
            k = next((k for k in range(len(waiting) - 1, -1, -1) if waiting[k][0] == w), None)
            if k is not None:
                out[waiting[k][1] : i] = [True] * (i - waiting[k][1])
                del waiting[k:]
            elif w in _CLOSES and len(waiting) < 8:
                waiting.append((_CLOSES[w], i))
    return out


class Scorer:
    def __init__(self, model: Model):
        self.trie = Trie(model.terms, model.exceptions)
        self.known: dict[str, float] = {}

    def _looked_up(self, word: str) -> float:
        terms = self.trie.terms
        if word in terms:
            return terms[word]
        if word in self.trie.exceptions or len(word) > 60:
            return 0.0
        best = 0.0
        if not word.isalnum():  # words that a sign joins
            best = max((self.weight(x) for x in _PART.findall(word)), default=0.0)
        forms = forms_of(word)
        best = max([best, *(DISGUISED * terms[x] for x in forms if x in terms)])
        if not best:
            for x in (word, *forms):
                if (found := self.trie.near(x)) is not None:
                    best = max(best, terms[found[0]] * (MISSPELLED if found[1] == 1 else MANGLED))
        return best

    def weight(self, word: str) -> float:
        w = self.known.get(word)
        if w is None:
            w = self._looked_up(word)
            if len(self.known) >= TABLE_ROWS:
                self.known.clear()
            self.known[word] = w
        return w

    def _hits(self, words: list[str]) -> list[tuple[int, float]]:
        """(place, weight) of the words that match, and of words spelled letter by letter."""
        known, distinct = self.known, set(words)
        for w in distinct:
            if w not in known:
                self.weight(w)
        hits = [(i, p) for i, w in enumerate(words) if (p := known[w] if w in known else self.weight(w))]
        if sum(len(w) == 1 and w.isalpha() for w in distinct) >= SPELLED - 1:
            i = 0
            while i < len(words):
                end = i
                while end < len(words) and len(words[end]) == 1 and words[end].isalpha():
                    end += 1
                if end - i >= SPELLED and (p := self.weight("".join(words[i:end]))):
                    hits.append((i, DISGUISED * p))
                i = end + 1
        return sorted(hits)

    def score(self, text: str | None) -> float:
        words = words_of(text)
        hits = self._hits(words)
        if not hits:
            return 0.0
        enclosed = quoted(words) if not _MARKS.isdisjoint(words) else None
        left = 1.0
        for i, p in hits:
            if enclosed is not None and enclosed[i]:
                p *= QUOTED
            elif not _REPORTING.isdisjoint(words[max(0, i - WINDOW) : i]):
                p *= REPORTED
            left *= 1 - p
        return 1 - left


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task: words with the toxic and the clean documents that hold them, given out whenever there are many."""
    toxic, clean = Counter(), Counter()

    def out() -> pa.RecordBatch:
        words = list(toxic.keys() | clean.keys())
        made = pa.record_batch([pa.array(words, pa.string()), pa.array([toxic[w] for w in words], pa.int64()), pa.array([clean[w] for w in words], pa.int64())], ["word", "n_toxic", "n_clean"])
        toxic.clear()
        clean.clear()
        return made

    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            (toxic if label else clean).update({w for w in words_of(text) if 2 < len(w) <= 40})
            if len(toxic) + len(clean) > 300_000:
                yield out()
    yield out()


def _ratio(t: int, c: int, base: float) -> float:
    """Log likelihood ratio of t toxic and c clean holders against the overall share of toxic ones."""
    n = t + c
    return t * math.log(t / (n * base)) + (c * math.log(c / (n * (1 - base))) if c else 0.0)


def learn(labelled: DataFrame, text_col: str, label_col: str, min_support: int = 3, min_precision: float = 0.5) -> Model:
    """Model from labelled rows.  Counts cover all rows; what is collected are words of theirs that qualify."""
    rows = labelled.where(F.col(f"`{label_col}`").isNotNull()).select(F.col(f"`{text_col}`").alias("text"), (F.col(f"`{label_col}`") > 0).alias("toxic"))
    counts = materialise(rows.mapInArrow(_counts, "word string, n_toxic bigint, n_clean bigint").groupBy("word").agg(F.sum("n_toxic").alias("t"), F.sum("n_clean").alias("c")))
    try:
        return _learned(rows, counts, min_support, min_precision)
    finally:
        release(counts)


def _learned(rows: DataFrame, counts: DataFrame, min_support: int, min_precision: float) -> Model:
    total = counts.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t"), F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count_if(F.col("t") > 0).alias("tried")).first()
    if not total["t"]:
        return Model()
    t, c = F.col("t"), F.col("c")
    base = min(0.9, total["t"] / (total["t"] + total["c"]))
    clean_part = F.when(c > 0, c * F.log(c / ((t + c) * (1 - base)))).otherwise(0.0)
    ratio = t * F.log(t / ((t + c) * base)) + clean_part
    precision = t / (t + 3 * c + 0.5)
    chance = math.log(total["tried"]) + 3
    tried = {r["word"]: (r["t"], r["c"]) for r in counts.where((t >= min_support) & (precision >= min_precision) & (ratio >= chance)).collect()}
    if not tried:
        return Model()
    sent_tried = rows.sparkSession.sparkContext.broadcast(tried)

    def contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in batch.column(0).to_pylist():
                words = ["", *words_of(text), ""]
                found.update((w, f"{words[i]} {words[i + 2]}") for i, w in enumerate(words[1:-1]) if w in sent_tried.value)
            yield pa.record_batch([pa.array([w for w, _ in found], pa.string()), pa.array([x for _, x in found], pa.string())], ["word", "context"])

    shown = rows.where("toxic").select("text").mapInArrow(contexts, "word string, context string").distinct().groupBy("word").count()
    terms = {}
    for r in shown.collect():
        n, m = tried[r["word"]]
        n = min(n, r["count"])
        p = n / (n + 3 * m + 0.5)
        if n >= min_support and p >= min_precision and _ratio(n, m, base) >= chance:
            terms[r["word"]] = p
    if not terms:
        return Model()
    sent = rows.sparkSession.sparkContext.broadcast(terms)

    def beside(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(sent.value))
        for batch in batches:
            words = batch.column(0).to_pylist()
            yield batch.filter(pa.array([w not in scorer.trie.terms and scorer.weight(w) > 0 for w in words], pa.bool_()))

    near = counts.where((c > 0) & (precision < min_precision)).select("word").mapInArrow(beside, "word string")
    return Model(terms, frozenset(r["word"] for r in near.collect()))


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text", out: str | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a score between 0 and 1; narrow.  Returns the frame and the column's name."""
    out = out or unused_name(docs, "toxicity")
    sent = docs.sparkSession.sparkContext.broadcast(model)
    held: dict = {}

    def scored(text: pa.Array) -> pa.Array:
        if "scorer" not in held:
            held["scorer"] = Scorer(sent.value)
        return pa.array([held["scorer"].score(t) for t in text.to_pylist()], pa.float64())

    scored.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return docs.withColumn(out, F.arrow_udf(scored, "double").asNondeterministic()(F.col(f"`{text_col}`"))), out
