"""Language models against a plain Kneser-Ney, kept whole, cut into pieces, and calibrated on texts that weren't counted."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import language_id


def plain_model(texts, alphabet):
    """Probability of a character after a context, by interpolated Kneser-Ney with dictionaries of strings."""
    d, top = language_id.DISCOUNT, language_id.ORDER
    counts = {top: Counter()}
    for t in texts:
        padded = " " * (top - 1) + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        counts[top].update(padded[k : k + top] for k in range(len(padded) - top + 1))
    for n in range(top - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    total, kinds = defaultdict(float), Counter()
    for n in counts:
        for g, c in counts[n].items():
            total[n, g[:-1]] += c
            kinds[n, g[:-1]] += 1

    def p(n, context, c):
        if not n:
            return 1 / alphabet
        context = context[len(context) - n + 1 :]
        low = p(n - 1, context, c)
        if not total[n, context]:
            return low
        return (max(counts[n][context + c] - d, 0) + d * kinds[n, context] * low) / total[n, context]

    return lambda context, c: p(top, context, c)


@pytest.mark.parametrize("entries,held", [(2_000_000, 256_000_000), (40, 0)])
def test_probabilities_equal_plain_ones(spark, monkeypatch, entries, held):
    monkeypatch.setattr(language_id, "PIECE_ENTRIES", entries)
    monkeypatch.setattr(language_id, "HELD_BYTES", held)
    rng = random.Random(3)
    made = {"xx": "abcd é", "yy": "cdefß 日"}
    texts = {x: ["".join(rng.choice(abc) for _ in range(rng.randint(1, 60))) for _ in range(30)] for x, abc in made.items()}
    rows = [(x, t) for x, own in texts.items() for t in own]
    counts = spark.createDataFrame(rows, "lang string, text string").select("text", "lang").mapInArrow(language_id._counted, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    model = language_id.model_of(counts)
    assert model.langs == ["xx", "yy"] and (min(model.pieces) > 3 if entries == 40 else model.pieces == [1, 1]) and (model.held is None) == (held == 0)
    alphabet = len({c for own in texts.values() for t in own for c in f" {' '.join(t.split())} "}) + 1
    plain = [plain_model(texts[x], alphabet) for x in model.langs]
    probes = [t for own in texts.values() for t in own][::9] + ["zzq abc", "日本 cd", "\U00010400\U00010401ab"]
    for t in probes:
        codes, _ = language_id.codes_of([t])
        padded = "   " + " ".join(t.split()).lower() + " "
        assert len(codes) == len(padded)
        logp, back = language_id.log_probabilities(model, codes)
        for k in range(3, len(padded)):
            for j in range(2):
                assert logp[back[k], j] == pytest.approx(math.log(plain[j](padded[k - 3 : k], padded[k])), abs=1e-6)
    ce, length = language_id.entropies(model, [probes[0], None, probes[1]])
    want = -sum(math.log(plain[0](("   " + probes[0] + " ")[k - 3 : k], ("   " + probes[0] + " ")[k])) for k in range(3, len(probes[0]) + 4)) / (len(probes[0]) + 1)
    if probes[0] == " ".join(probes[0].split()):
        assert ce[0, 0] == pytest.approx(want, abs=1e-6)
    assert length[1] == 0


def test_all_ngrams_are_kept(spark):
    rng = random.Random(4)
    letters = [chr(0x4E00 + k) for k in range(3000)]
    rows = [("zz", "".join(rng.choices(letters, k=60_000))) for _ in range(4)] + [("aa", "calm words of plain text ") for _ in range(8)]
    model = language_id.learn(spark.createDataFrame(rows, "lang string, text string"))
    found = [model.piece("zz", k).of for k in range(model.pieces[1])]
    counted = sum(len(of[4][0]) for of in found)
    # texts that aren't kept for calibration: all their n-grams, nearly all of them seen once
    assert model.langs == ["aa", "zz"] and counted > 100_000
    assert sum(len(of[1][0]) for of in found) == 3001
    langs, _, _ = language_id.predict(model, [rows[0][1][:400], "plain words of calm text"])
    assert langs == ["zz", "aa"]


def test_calibration_by_different_texts_that_were_not_counted(spark):
    rng = random.Random(6)
    rows = [(lang, " ".join("".join(rng.choices(abc, k=rng.randint(2, 6))) for _ in range(rng.randint(1, 20)))) for lang, abc in (("x", "abcde"), ("y", "defgh")) for _ in range(1500)]
    rows += [("x", "abc ed " * 600)] * 500
    df = spark.createDataFrame(rows, "lang string, text string")
    model = language_id.learn(df)
    kept = df.where(F.pmod(F.xxhash64(F.xxhash64("text")), F.lit(language_id.CALIBRATION_SHARE)) == 0).distinct().collect()
    assert 150 < len(kept) < 450
    ce, length = language_id.entropies(model, [r["text"] for r in kept])
    for j, lang in enumerate(model.langs):
        own = ce[np.array([r["lang"] == lang for r in kept]) & (length >= 20), j]
        assert (model.mean[j], model.deviation[j]) == (pytest.approx(own.mean()), pytest.approx(max(own.std(), 0.05)))


def test_no_language_is_lost(spark):
    """Languages of one text, whether its hash falls into the calibrating tenth or not, ties, clashing names and long texts."""
    rows = [(f"l{k:02}", "".join(chr(0x3B1 + (k * 7 + j * j) % 24) + (" " if j % 6 == 5 else "") for j in range(90))) for k in range(40)]
    df = spark.createDataFrame(rows + [("l99", None), (None, "alpha beta")], "lang string, text string")
    model = language_id.learn(df)
    assert model.langs == [x for x, _ in rows]
    twin = language_id.learn(spark.createDataFrame([("b", "same text here"), ("a", "same text here")], "lang string, text string"))
    docs = spark.createDataFrame([("same text here", 1, "x"), ("text " * 200_000, 2, "x"), (None, 3, "x")], "text string, lang int, language string")
    out, c = language_id.with_language(docs, twin)
    assert c == "_language" and {r["lang"]: r[c]["lang"] for r in out.collect()} == {1: "a", 2: "a", 3: "und"}
    assert language_id.with_language(docs.limit(0), twin)[0].count() == 0
