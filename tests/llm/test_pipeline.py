"""The pipeline's stages, each on what its predecessor kept, against plain versions; empty tables and clashing names."""

import random
import re
import unicodedata

import corpus_pipeline
import pyarrow as pa
import pytest
from pairloom import session
from pairloom.llm import mixing, toxicity
from pairloom.llm.queries import toxicity_model
from tests.llm.test_llm import _contamination, _measures
from tests.llm.test_ngram_join import all_pairs
from tests.llm.test_toxicity import plain_score

NAMES = "mix_slot string, x_id int, s string, bad_id int, group_head int, quality_bits int, words string, toxicity double, mix_key int"


def plain_quality(text):
    n_words, word_chars, n_symbols, n_dup, n_repeat = _measures(text)
    kinds = [unicodedata.category(c) for c in text or ""]
    letters, upper = sum(k[0] in "LM" for k in kinds), kinds.count("Lu")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return not (
        n_words < 50 or 100 * n_repeat > 50 * n_words or 4 * n_symbols > n_words or letters and 2 * upper > letters or n_dup >= 3 and 10 * n_dup > 3 * len(lines)
        or n_words and word_chars < 2 * n_words or word_chars > 20 * n_words or 2 * letters < word_chars
    )


def corpus(rng):
    plain = [f"plain{chr(97 + k // 30)}{chr(97 + k % 26)}" for k in range(780)]
    item = " ".join(f"bench{k}" for k in range(30))
    texts, labels = [], []
    for k in range(180):
        w = [rng.choice(plain) for _ in range(rng.randint(45, 120))]
        toxic = int(k % 6 == 1)
        for _ in range(4 * toxic):
            w.insert(rng.randrange(len(w)), rng.choice(["vileword", "scoundrel"]))
        if k % 9 == 2:
            at = rng.randrange(17)
            w[5:5] = item.split()[at : at + 13]
        texts.append(" ".join(w).replace(" ", "\n", 1))
        labels.append(toxic)
    for k in (3, 9, 15, 21):
        w = texts[k].split()
        texts += [texts[k], " ".join([*w[:20], "changed", *w[21:]]), " ".join([*w[:7], "other", *w[8:30], "thing", *w[31:]])]
    texts += [None, "", "too short", "AND SHOUTED " * 60, "$$ %% " * 60, "x", "word " * 30_000, texts[4].upper(), "long " + " ".join(rng.choice(plain) for _ in range(20_000)), "you vilewod " + texts[10]]
    return texts, labels, item


def test_stages_equal_plain_ones(spark, tmp_path):
    rng = random.Random(23)
    texts, labels, item = corpus(rng)
    ids = [*range(len(texts))]
    rows = [(i, t, "en", None if i % 7 == 3 else "hot" if i % 3 else f"src{i % 4}", 1, "a", i, "b", i, 1, 2, "c", 0.5, 3) for i, t in zip(ids, texts, strict=True)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, " + NAMES).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, t) for i, t in enumerate(labels)], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "x"), (None, None)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    terms = toxicity_model(spark, docs, folder).terms
    assert set(terms) == {"vileword", "scoundrel"}

    def near(kept):
        root = all_pairs([texts[i] for i in kept])[1]
        return [i for k, i in enumerate(kept) if root[k] == k]

    plain = {
        "quality_rules": lambda kept: [i for i in kept if plain_quality(texts[i])],
        "toxicity": lambda kept: [i for i in kept if plain_score(terms, texts[i] or "") < 0.7],
        "ngram_join": near,
        "decontamination": lambda kept: [i for i, w in zip(kept, _contamination([texts[i] for i in kept], [(1, item), (2, "x")]), strict=True) if not w[4]],
        "mixing": lambda kept: kept,
    }
    kept = ids
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        want = plain[name](kept)
        assert len(want) < len(kept) or name == "mixing", name
        assert sorted(r["doc_id"] for r in out.select("doc_id").collect()) == want, name
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{folder}/stage{k}")
            docs = spark.read.parquet(f"{folder}/stage{k}")
        kept = want
    assert out.columns == [*docs.columns, "_mix_slot", "mix_block", "mix_start"]
    got = out.collect()
    size = {}
    for r in got:
        size[r["source"] or ""] = size.get(r["source"] or "", 0) + len(r["text"].encode())
    slots = {x: t for t, x in enumerate(mixing.fluid_slots({s: -(-n // mixing.BLOCK_BYTES) for s, n in size.items()}, {s: n**0.5 for s, n in size.items()}))}
    assert all(r["_mix_slot"] == slots[r["source"] or "", r["mix_block"]] for r in got)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()) == kept


def test_stages_of_nothing(spark, tmp_path):
    folder = str(tmp_path)
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + NAMES)
    empty.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
    assert toxicity.Model().terms == {} and corpus_pipeline.run(spark, folder).count() == 0


def _sizes(batches):
    for b in batches:
        yield pa.record_batch([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "size"])


@pytest.mark.parametrize("k", [0, 1, 2])
def test_batches_for_workers_are_small(spark, tmp_path, k):
    """After a stage with Python code a worker gets few rows and bytes at once, also of long texts; a lower setting stays."""
    folder = str(tmp_path)
    spark.createDataFrame([(1, "a b c", "s")], "doc_id bigint, text string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    names = ["spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"]
    try:
        for name in names:
            spark.conf.unset(name)
        corpus_pipeline.STAGES[k][1](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
        rows = spark.range(0, 5000, 1, 1)
        assert max(r["n"] for r in rows.mapInArrow(_sizes, "n bigint, size bigint").collect()) <= session.BATCH_ROWS
        long = rows.where("id < 300").selectExpr("id", "repeat('w', 100000) AS text").mapInArrow(_sizes, "n bigint, size bigint").collect()
        assert sum(r["n"] for r in long) == 300 and max(r["size"] for r in long) <= 2 * session.BATCH_BYTES
        spark.conf.set(names[0], "7")
        session.small_batches(spark)
        assert spark.conf.get(names[0]) == "7"
    finally:
        for name in names:
            spark.conf.unset(name)


def test_mixing_starts_no_python_workers(spark, monkeypatch):
    """A list made a frame goes through workers of a kind of its own, which executors keep beside the others."""
    docs = spark.createDataFrame([(1, "a b c", "s"), (2, "d", None)], "doc_id bigint, text string, source string")
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", None)
    assert corpus_pipeline.mixing_stage(spark, docs, "").count() == 2
