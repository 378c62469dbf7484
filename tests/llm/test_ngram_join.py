"""The join against all pairs: on the given documents, by both ways of verifying, with ids and names of any kind."""

import os
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import ngram_join as nj

TABLES = "/root/testdata/sf0.01"


def all_pairs(texts):
    """(links of each text, root of each text's group), by an inverted list of shingles."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    holders = {}
    for k, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(k)
    links, root = [0] * len(texts), [*range(len(texts))]

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, s in enumerate(sets):
        common = Counter(o for x in s for o in holders[x] if o < k)
        for o, both in common.items():
            if 10 * both >= 8 * (len(s) + len(sets[o]) - both):
                links[k] += 1
                links[o] += 1
                a, b = find(k), find(o)
                root[max(a, b)] = min(a, b)
    return links, [find(k) for k in range(len(texts))]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    links, root = all_pairs([t for _, t in rows])
    got = {r["doc_id"]: r for r in nj.ngram_join(docs).collect()}
    assert sum(links) > 100
    assert [got[i]["n_links"] for i, _ in rows] == links and [got[i]["class_id"] for i, _ in rows] == [rows[k][0] for k in root]


def test_large_group_over_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 40)
    monkeypatch.setattr(nj, "BUCKET_BLOCK", 30)
    rng = random.Random(4)
    shared = [f"s{k}" for k in range(60)]
    texts = []
    for _ in range(160):  # one group of near copies, and texts that share half of it
        w = [f"v{k}" for k in range(100)]
        w[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
        texts.append(" ".join([*shared, *(f"y{rng.randrange(10**6)}" for _ in range(40))]))
    texts += ["very long " + " ".join(f"l{k}" for k in range(60_000))] * 2 + ["edge " * 30, None]
    ids = [f"id-{rng.randrange(10**9)}" for _ in texts]
    df = spark.createDataFrame([(i, t, k, "x", True) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], "doc_id string, text string, x_id int, group_id string, x_hash boolean")
    links, root = all_pairs(texts)
    least = {}
    for k, r in enumerate(root):
        least[r] = min(least.get(r, ids[k]), ids[k])
    got = {r["doc_id"]: r for r in nj.ngram_join(df).collect()}
    assert [got[i]["n_links"] for i in ids] == links and [got[i]["class_id"] for i in ids] == [least[r] for r in root]
    kept = nj.one_of_each_group(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))
    assert nj.ngram_join(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=1, max_size=8), st.lists(st.sets(st.integers(0, 40), min_size=1), min_size=1, max_size=8))
def test_product_equals_pairs(left, right):
    sets = [np.array(sorted(s), np.uint64) for s in left + right]
    a, b = np.arange(len(left)), np.arange(len(left), len(sets))
    x, y = np.repeat(a, len(b)), np.tile(b, len(a))
    want = [len(left[i] & right[j - len(left)]) for i, j in zip(x, y, strict=True)]
    assert nj._common_by_pair(sets, x, y).tolist() == want
    assert nj._common_by_product(sets, a, b)[x, y - len(left)].tolist() == want
