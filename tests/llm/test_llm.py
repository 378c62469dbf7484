"""Brute-force comparisons and edge cases of the training-data operators."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.llm import decontamination, html_extraction, language_id, license_scan, mixing, ngram_join, quality_rules, token_counts, toxicity, warc

tokenizers_path = pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def by_id(df, key="doc_id"):
    return {r[key]: r.asDict() for r in df.collect()}


def docs_of(spark, texts, ids=None):
    """Documents with a column that clashes with names the operators use."""
    rows = [(k if ids is None else ids[k], t, "en", f"src{k % 3}", 7, "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_words int, quality_bits string")


# ---------------------------------------------------------------- 1


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def _contamination(texts, items):
    windows = {}
    for item, text in items:
        w = _words(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for text in texts:
        w, hit, found = _words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        ids = sorted(str(x) for x in found if x is not None)
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["alpha", "Beta", "été", "gamma", "x1", "d", "É", "zeta"]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 12, 13, 14, 30, 60])))) for k in range(12)] + [(50, ""), (51, None), (None, "only here we go"), (52, "a a a a a a a a a a a a a a a a a a")]
    texts = [None, "", " .,! ", "a " * 40, "alpha"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            item = rng.choice(items)[1] or ""
            w = item.split()
            lo = rng.randint(0, max(0, len(w) - 13))
            parts.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 20))))
            parts.append((", " if rng.random() < 0.5 else " ").join(w[lo : lo + rng.randint(5, 30)]).swapcase() if rng.random() < 0.2 else " ".join(w[lo : lo + rng.randint(5, 30)]))
        texts.append("\n".join(parts))
    texts += [texts[-1], texts[-1]]
    docs = docs_of(spark, texts)
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = by_id(decontamination.with_contamination(docs, bench))
    for k, want in enumerate(_contamination(texts, items)):
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == want, (k, texts[k])
    kept = decontamination.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, w in enumerate(_contamination(texts, items)) if not w[4]}


def test_decontamination_of_nothing(spark):
    docs = docs_of(spark, ["one two", None], [None, None])
    none = spark.createDataFrame([], "item_id int, text string")
    assert sorted(tuple(r) for r in decontamination.with_contamination(docs, none).select("n_words", "n_hit", "contaminated").collect()) == [(0, 0, False), (2, 0, False)]
    assert decontamination.with_contamination(docs.limit(0), none).count() == 0


# ---------------------------------------------------------------- 2


def _measures(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    repeated = {p for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é#|\n\t\x0b 日\U0001f600", max_size=80))
def test_measures_equal_brute_force(text):
    assert quality_rules.measure(text)[:5] == _measures(text)


def test_quality_ledger(spark):
    texts = [None, "", "word " * 60, " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)), "\n".join(["same line here"] * 5), " ".join(f"letters{k}$$$" for k in range(80)), "x" * 200_000]
    docs = docs_of(spark, texts)
    ledger, m, bits = quality_rules.with_ledger(docs)
    assert ledger.columns[: len(docs.columns)] == docs.columns
    kept = {r["doc_id"] for r in ledger.where(quality_rules.passes(bits)).collect()}
    assert kept == {3}
    table = {r["rule"]: (r["failed"], r["only_this"]) for r in quality_rules.ablation(ledger, bits).collect()}
    assert table["few_words"][0] == 4 and table["symbols"] == (1, 1)
    assert quality_rules.ablation(ledger.limit(0), bits).agg(F.sum("failed")).first()[0] == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="Aé日️★☐ñǅÉσ😀́ि", max_size=40))
def test_letters_of_any_script(text):
    import unicodedata

    m = dict(zip(quality_rules.MEASURES, quality_rules.measure(text), strict=True))
    kinds = [unicodedata.category(c) for c in text]
    assert m["n_letters"] == sum(k[0] in "LM" for k in kinds) and m["n_upper"] == kinds.count("Lu")


def test_policies_over_a_stored_ledger(spark):
    """Boxes and stars aren't letters, words of other scripts are; policies and what rules do alone come from the ledger."""
    texts = ["★☐😀 " * 60, " ".join(f"हिन्दी{chr(0x915 + k // 8)}{chr(0x915 + k % 8)}" for k in range(60)), None, " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(60)), "a b " * 30]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)] * 2, "key int, body string, rule_bits int, n_words string")
    ledger = quality_rules.stored_ledger(docs, "key", "body")
    kept = {p: sorted(r["doc_id"] for r in ledger.where(quality_rules.passes("rule_bits", p)).collect()) for p in quality_rules.POLICIES}
    assert kept["strict-1"] == [1, 1, 3, 3] and ledger.count() == 10
    few = {r["doc_id"]: r["rule_bits"] >> 7 & 1 for r in ledger.collect()}
    assert few == {0: 1, 1: 0, 2: 0, 3: 0, 4: 0}
    table = {r["rule"]: (r["failed"], r["only_this"]) for r in quality_rules.ablation(ledger, "rule_bits", "form-1").collect()}
    assert set(table) == set(quality_rules.POLICIES["form-1"]) and table["few_words"] == (2, 2)
    assert quality_rules.stored_ledger(docs.limit(0), "key", "body").count() == 0


# ---------------------------------------------------------------- 3


def test_language_models(spark):
    rng = random.Random(1)
    made = {"aa": ["ka", "ro", "ti"], "bb": ["sch", "ung", "der"], "cc": ["ção", "lha", "que"]}
    rows = []
    for k in range(240):
        lang = sorted(made)[k % 3]
        rows.append((k, " ".join("".join(rng.choice(made[lang]) for _ in range(3)) for _ in range(30)), lang if k % 9 else None))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language_id.learn(df.where("doc_id < 180"))
    extra = spark.createDataFrame([(900, None, "aa"), (901, "12 34 !", "aa"), (902, "", None), (903, "日本語の文章です" * 30, None)], df.schema)
    out, c = language_id.with_language(df.where("doc_id >= 180").unionByName(extra), model)
    got = by_id(out.select("doc_id", f"{c}.*"))
    assert all(got[k]["lang"] == sorted(made)[k % 3] and 0 <= got[k]["score"] <= 1 for k in range(180, 240))
    assert all(got[k]["lang"] == "und" and got[k]["score"] == 0 for k in (900, 901, 902)) and got[903]["rejected"]
    assert language_id.learn(df.limit(0)) is None
    nothing, c = language_id.with_language(extra, None)
    assert {r[0] for r in nothing.select(f"{c}.lang").collect()} == {"und"}


def test_language_probabilities_sum_to_one(spark):
    df = spark.createDataFrame([(0, "abcab cabba abc", "x"), (1, "bca cab bbb", "x")], "doc_id bigint, text string, lang string")
    model = language_id.learn(df)
    import numpy as np

    codes = np.array([ord(c) for c in " abc"], np.uint64)
    for context in ("   ", " ab", "abc", "ccc"):
        total = 0.0
        for c in codes:
            logp, back = language_id.log_probabilities(model, np.concatenate([np.array([ord(x) for x in context], np.uint64), [c]]))
            total += float(np.exp(logp[back[-1], 0]))
        assert 0.8 < total <= 1.001  # one code in five is kept for unseen characters


# ---------------------------------------------------------------- 4


def test_license_scan(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/c/x.py", "print(1)"), ("a/b/y.py", "# Licensed under the Apache License, Version 2.0.\nimport os\n" + "x = 1\n" * 50), ("z/q.py", None), (None, "no licence at all"),
        ("a/b/LICENSE.txt", "This work is licensed under the GNU General Public License, version 3."), ("a/b/c/x.py", "print(1)"), ("a/w.py", ""), ("top.py", "free"),
    ]
    df = spark.createDataFrame(files, "path string, text string")
    got = license_scan.licence_scan(df).collect()
    assert len(got) == len(files)
    by = {r["path"]: (r["own_licence"], r["licence"], r["inherited_from"], r["is_licence_file"]) for r in got}
    assert by["a/b/c/x.py"] == (None, "GPL-3.0", "a/b", False) and by["a/b/y.py"] == ("Apache-2.0", "Apache-2.0", None, False)
    assert by["a/LICENSE"] == ("MIT", "MIT", None, True) and by["a/w.py"] == (None, "MIT", "a", False) and by["z/q.py"][1] is None and by[None][1] is None and by["top.py"][1] is None
    assert license_scan.licence_scan(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 5


def _near_texts():
    rng = random.Random(8)
    base = [[f"w{rng.randrange(5000)}" for _ in range(rng.randint(20, 120))] for _ in range(12)]
    texts = [None, "", "  ", "one two three", "one two three", "One Two  three"]
    for b in base:
        for _ in range(rng.randint(1, 12)):
            w = [*b]
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                w[rng.randrange(len(w))] = f"w{rng.randrange(5000)}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return texts


def _join(texts):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    root, links = [*range(len(texts))], [0] * len(texts)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] and sets[b] and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(k) for k in range(len(texts))], links


def test_ngram_join_equals_brute_force(spark, monkeypatch):
    texts = _near_texts()
    docs = docs_of(spark, texts)
    classes, links = _join(texts)
    got = by_id(ngram_join.ngram_join(docs))
    assert [got[k]["class_id"] for k in range(len(texts))] == classes and [got[k]["n_links"] for k in range(len(texts))] == links
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(classes)


def test_blocks_of_a_large_group(spark, monkeypatch):
    """A group over many blocks gives what one block gives."""
    texts = _near_texts()
    docs = docs_of(spark, texts)
    monkeypatch.setattr(ngram_join, "BLOCK", 3)
    classes, links = _join(texts)
    got = by_id(ngram_join.ngram_join(docs))
    assert [got[k]["class_id"] for k in range(len(texts))] == classes and [got[k]["n_links"] for k in range(len(texts))] == links


def test_repeated_rows_stay_once(spark):
    docs = docs_of(spark, ["a b c d e f", "a b c d e f", "other words all along here now", None], [4, 4, 5, None])
    assert sorted(str(r["doc_id"]) for r in ngram_join.one_of_each_group(docs).collect()) == ["4", "5", "None"]
    assert ngram_join.one_of_each_group(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 6


def test_toxicity(spark):
    rng = random.Random(3)
    calm = [f"calm{k}" for k in range(300)]
    rows = []
    for k in range(400):
        w = [rng.choice(calm) for _ in range(40)]
        if k % 5 == 0:
            for _ in range(3):
                w.insert(rng.randrange(40), rng.choice(["vileword", "rotter", "scoundrel"]))
        rows.append((k, " ".join(w), int(k % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    model = toxicity.learn(df, "text", "toxic")
    assert set(model.terms) == {"vileword", "rotter", "scoundrel"}
    texts = [None, "", "calm1 calm2", "you vileword calm3", "you vilewrod and vilewod calm3 rottr", 'they wrote " vileword " and it was quoted']
    out, c = toxicity.with_toxicity(docs_of(spark, texts), model)
    got = {r["doc_id"]: r[c] for r in out.collect()}
    assert got[0] == got[1] == got[2] == 0 and got[3] > 0.9 and 0.5 < got[4] < 1 and got[5] < 0.5 < got[3]
    assert toxicity.learn(df.where("toxic = 0"), "text", "toxic").terms == {}


# ---------------------------------------------------------------- 7


def test_mixing_keeps_all_rows(spark):
    docs = docs_of(spark, [None if k == 3 else "word " * (k % 17) for k in range(200)] + ["same text"] * 5, [*range(200), 7, 7, 7, None, None]).withColumn("source", F.when(F.col("doc_id") % 3 == 0, F.lit(None)).otherwise(F.col("source"))).withColumn("mix_slot", F.lit("mine"))
    out = mixing.mixed(docs, block_bytes=100)
    assert out.columns[: len(docs.columns)] == docs.columns and out.count() == docs.count()
    assert out.select("text", "doc_id").exceptAll(docs.select("text", "doc_id")).isEmpty()
    own = {}
    for r in out.collect():
        own.setdefault((r["source"], r["mix_block"]), set()).add(r["_mix_slot"])
    assert all(len(x) == 1 for x in own.values())
    assert mixing.mixed(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 8


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("<p> </p>", ""), ("plain", "plain"), ("<p>a&amp;b<p>c&eacute; d", "a&b cé d"),
        ("<script>if(a</b){x('</p>')}</script><article><h1>T</h1><p>One <b>bo</b>ld, two.</p><!-- <p>no</p> --></article><footer>foot</footer>", "T One bold, two."),
        ('<div class="cookie-notice">We use cookies, many, many cookies, and say so at great length here.</div><main><p>Body text, real one.</p></main>', "Body text, real one."),
        ('<article><p>First, one.</p><div class="ad">Buy, now, please, all.</div><p>Second.</p></article><section class="comments"><p>I, for one, liked, this, a, lot.</p></section>', "First, one. Second."),
        ("<ul><li><a href=x>a</a><li><a href=y>b</a><li><a>c</a></ul><div><p>Text, with words.</p></div><aside>Side</aside><form><label>n</label></form>", "Text, with words."),
        ('<div class="page has-sidebar"><h1>T</h1><p>Long, text of the page itself.</p><div class="sidebar"><p>Side, text.</p></div></div>', "T Long, text of the page itself."),
        ('<div class="menu-open"><main><p>Body, here.</p></main></div><section id="comments"><article class="comment"><h1>x</h1><p>No, no.</p></article></section>', "Body, here."),
        ('<p title="a>b">in, text</p>', "in, text"), ("<article><p>cut off, here <b>and", "cut off, here and"),
    ],
)
def test_main_text(page, want):
    assert html_extraction.main_text(page) == want


def test_deep_and_broken_pages():
    assert html_extraction.main_text("<div>" * 20_000 + "deep, text") == "deep, text"
    assert html_extraction.main_text('<p "' * 2000) is not None
    assert html_extraction.main_text("<div class=x>" * 20_000 + "</section>" * 20_000 + "deep, text" + "<b>" * 20_000 + "<p>x, y") == "deep, text x, y"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/p bdiv!-\"'&;=a ", max_size=60))
def test_any_markup_ends(page):
    html_extraction.main_text(page)


# ---------------------------------------------------------------- 9


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aÉ́ \x1c \n<|endoftext|>'s", max_size=40))
def test_token_counts_equal_the_library(text):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizers_path)
    assert token_counts.count_tokens([text], tokenizers_path) == ([len(text.encode())], [len(own.encode(text, add_special_tokens=False).ids)])


def test_token_query_shape(spark):
    docs = docs_of(spark, [None, "", "hello world", "a" * 50_000, "word " * 3000])
    out, c = token_counts.with_token_counts(docs, tokenizers_path)
    got = by_id(out.select("doc_id", f"{c}.*"))
    assert (got[0]["n_tokens"], got[1]["n_bytes"], got[2]["n_tokens"], got[4]["over_limit"], got[2]["over_limit"]) == (0, 0, 2, True, False)


# ---------------------------------------------------------------- 10


def test_archives(spark, tmp_path):
    pages = [(3, "http://b.example/x", "same"), (1, "http://a.example/y?q=1", "same"), (2, None, None), (5, "http://a.example/y?q=1", "ünï\r\n\r\n"), (4, "http://a.example/é %41\n", ""), (None, "http://c.example/", "same"), (7, "http://c.example/", "alone")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    index = warc.merge_runs(warc.write_archives(df.repartition(3), f"file://{tmp_path}/w"))
    parts = index.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("n"), "key", "ts").collect()
    order = [(r["key"], r["ts"]) for r in sorted(parts, key=lambda r: r["n"])]
    assert order == sorted(order)
    got = by_id(warc.read_records(index, f"file://{tmp_path}/w"), "page_id")
    assert {k: (r["record_type"], r["refers_to"]) for k, r in got.items()} == {1: ("response", None), 3: ("revisit", 1), None: ("revisit", 1), 2: ("response", None), 4: ("revisit", 2), 5: ("response", None), 7: ("response", None)}
    assert got[5]["payload_bytes"] == len("ünï\r\n\r\n".encode()) and got[3]["payload_digest"] == warc.digest_of(b"same") and got[3]["payload_bytes"] == 4
    assert warc.archive_round_trip(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9)), max_size=9))
def test_loser_tree(runs):
    made = warc.LoserTree([iter([(x, x) for x in sorted(r)]) for r in runs])
    assert [*made] == sorted(x for r in runs for x in r)


# ---------------------------------------------------------------- the pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    words = [f"plain{chr(97 + k // 30)}{chr(97 + k % 26)}" for k in range(780)]
    item = " ".join(f"bench{k}" for k in range(30))
    rows, labels = [], []
    for k in range(240):
        w = [rng.choice(words) for _ in range(80)]
        toxic = int(k % 6 == 1)
        if toxic:
            for _ in range(4):
                w.insert(rng.randrange(80), rng.choice(["vileword", "scoundrel"]))
        rows.append([k, " ".join(w), "en", f"src{k % 4}", 0])
        labels.append((k, 1, toxic))
    rows[12][1] = rows[6][1]
    rows[18][1] = rows[6][1].replace(rows[6][1].split()[40], "changed", 1)
    rows[24][1] += " " + item
    rows[30][1] = "too short"
    rows[36][1] = None
    folder = str(tmp_path)
    spark.createDataFrame([tuple(r) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder)
    toxic = {k for k, _, t in labels if t}
    assert {r["doc_id"] for r in out.collect()} == set(range(240)) - toxic - {12, 18, 24, 30, 36}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "ngram_join", "decontamination", "mixing"]
    assert zlib.crc32(b"1") % 3 in (0, 1, 2)
