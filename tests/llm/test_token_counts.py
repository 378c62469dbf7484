"""Token counts against the libraries, for every installed kind of tokenizer."""

import random

import pytest

from pairloom.llm import token_counts

public_tokenizers = pytest.importorskip("public_tokenizers")


def _library(path):
    if path.endswith(".json"):
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        return lambda texts: [len(e) for e in own.encode_batch(texts, add_special_tokens=False)]
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in model.encode(texts)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_equal_the_library(name, monkeypatch):
    monkeypatch.setattr(token_counts, "LONG_BYTES", 30)  # so that long pieces are cut further
    monkeypatch.setattr(token_counts, "GROUP_BYTES", 5000)
    path, rng = public_tokenizers.path(name), random.Random(2)
    parts = [*"ab Z19é'  \x1c\n\t  .,<|>日本、。śΣ😀", "<|endoftext|>", "  ", "it's", "　", "▁", "x1y2", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(3000)] + ["", " ", "\n\n", None, "a" * 3000, "a1" * 2000, "日本、" * 2000]
    got = token_counts.count_tokens(texts, path)
    assert got[0] == [len((t or "").encode()) for t in texts]
    assert got[1] == _library(path)([t or "" for t in texts])


def test_texts_are_cut_where_that_is_safe():
    cuts = {n: token_counts.boundaries(public_tokenizers.path(n))[0] for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model")}
    assert len({f("one two three").__len__() for f in cuts.values()}) == 1 and all(len(f("one two three")) == 3 for f in cuts.values())


def test_an_unknown_definition_is_not_cut(tmp_path):
    import json

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        own = json.load(f)
    own["pre_tokenizer"]["use_regex"] = False
    (tmp_path / "odd.json").write_text(json.dumps(own), encoding="utf-8")
    texts = ["one two  three", "it's x1y2 " * 50]
    assert token_counts.count_tokens(texts, str(tmp_path / "odd.json"))[1] == _library(str(tmp_path / "odd.json"))(texts)


def test_limit_ties_and_tables(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(1, "word " * 2048, "x"), (2, "word " * 2049, "x"), (3, None, "x"), (4, " \n", "x"), (4, " \n", "x"), (5, "word " * 300_000, "x"), (6, "ab1" * 200_000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, token_counts string")
    out, c = token_counts.with_token_counts(df, path)
    assert c == "_token_counts"
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in out.select("doc_id", f"{c}.*").collect()}
    assert got[1][1:] == (2048, False) and got[2][1:] == (2049, True) and got[3] == (0, 0, False) and got[4] == (2, 0, False) and got[5][1] == 300_000
    assert got[6][1] == _library(path)(["ab1" * 200_000])[0]
    assert token_counts.with_token_counts(df.limit(0), path)[0].count() == 0
