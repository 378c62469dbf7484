"""Winnowing where the benchmark is too large to broadcast, with very long texts, ties, and names of the plan's own columns."""

import random

import pytest

from pairloom.llm import decontamination
from tests.llm.test_llm import _contamination


@pytest.mark.parametrize("bound", [0, 48 << 20])
def test_either_join(spark, monkeypatch, bound):
    monkeypatch.setattr(decontamination, "BROADCAST_BYTES", bound)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(30)]
    items = [(f"item {k}", " ".join(rng.choice(words) for _ in range(rng.choice([2, 13, 20, 40])))) for k in range(30)] + [("shared a", "one two three"), ("shared b", "ONE, two three")]
    long = [f"l{k}" for k in range(40_000)]
    long[20_000:20_013] = items[3][1].split()[:13]
    texts = [" ".join(long), " ".join(f"u{k}" for k in range(17)) + " one two three", " ".join(f"u{k}" for k in range(60)) + " one two three", None, "7"]
    for _ in range(40):
        source = rng.choice(items)[1]
        texts.append(" ".join(rng.choice(words) for _ in range(10)) + " " + source.upper() + " " + " ".join(rng.choice(words) for _ in range(rng.randint(0, 300))))
    rows = [(f"d{k}", t, "x", 1, 2, "r") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "name string, body string, run string, len int, n_hit int, bad_id string")
    bench = spark.createDataFrame(items, "doc_id string, prompt string")
    columns = {"id_col": "name", "text_col": "body", "item_id_col": "doc_id", "item_text_col": "prompt"}
    want = _contamination(texts, items)
    got = {r["doc_id"]: r for r in decontamination.with_contamination(docs, bench, **columns).collect()}
    for k, w in enumerate(want):
        r = got[f"d{k}"]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == w, k
    assert got["d1"]["contaminated"] and not got["d2"]["contaminated"]  # 3 of 20 words, and 3 of 63
    kept = decontamination.drop_contaminated(docs, bench, **columns)
    assert kept.columns == docs.columns and sorted(r["name"] for r in kept.collect()) == sorted(f"d{k}" for k, w in enumerate(want) if not w[4])
