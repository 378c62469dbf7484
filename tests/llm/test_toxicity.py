"""Matching and scores against plain versions: all terms by their distances, all words of a text one by one."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import toxicity as tx


def distance(a, b, swaps):
    """Edits between two words; with swaps, neighbours that are exchanged (and not edited otherwise) are one."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if swaps and i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def plain_near(terms, word):
    if len(word) < tx.FUZZY_LENGTH - 1:
        return None
    one = [t for t in terms if len(t) >= tx.FUZZY_LENGTH and t != word and distance(t, word, True) == 1]
    two = [t for t in terms if len(t) >= tx.LONG_LENGTH and t != word and distance(t, word, False) == 2]
    found = [(t, 1) for t in one] or [(t, 2) for t in two]
    return min(found, key=lambda x: (-terms[x[0]], x[0]), default=None)


@settings(max_examples=600, deadline=None)
@given(st.dictionaries(st.text(alphabet="abc", min_size=3, max_size=12), st.sampled_from([0.6, 0.9]), min_size=1, max_size=6), st.text(alphabet="abc", min_size=4, max_size=14))
def test_automaton_equals_distances(terms, word):
    if word not in terms:
        assert tx.Trie(terms).near(word) == plain_near(terms, word)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcde", min_size=10, max_size=14), st.lists(st.tuples(st.integers(0, 13), st.sampled_from(["add", "drop", "change"])), min_size=1, max_size=2))
def test_no_filter_hides_two_edits(term, edits):
    word = term
    for at, kind in edits:
        at %= max(1, len(word))
        word = word[:at] + ("x" if kind != "drop" else "") + word[at + (kind != "add") :]
    if word != term and len(word) >= tx.LONG_LENGTH - 2:
        assert tx.Trie({term: 0.9}).near(word) == (term, distance(term, word, True) if distance(term, word, True) == 1 else 2)


def plain_score(terms, text):
    words = tx.words_of(text)
    enclosed = [False] * len(words)
    lines, line = [], []
    for i, w in enumerate(words):
        if w == "\n":
            lines, line = [*lines, line], []
        else:
            line.append(i)
    for own in [*lines, line]:  # straight marks pair up in order
        marks = [i for i in own if words[i] == '"']
        for a, b in zip(marks[::2], marks[1::2], strict=False):
            enclosed[a:b] = [True] * (b - a)
    left = 1.0
    for i, w in enumerate(words):
        p = terms.get(w, 0.0)
        if not p and w not in ('"', "\n"):
            forms = tx.forms_of(w)
            p = max((tx.DISGUISED * terms[x] for x in forms if x in terms), default=0.0)
            if not p:
                for x in (w, *forms):
                    near = plain_near(terms, x)
                    if near is not None:
                        p = max(p, terms[near[0]] * (tx.MISSPELLED if near[1] == 1 else tx.MANGLED))
        if p:
            if enclosed[i]:
                p *= tx.QUOTED
            elif any(x in tx._REPORTING for x in words[max(0, i - tx.WINDOW) : i]):
                p *= tx.REPORTED
            left *= 1 - p
    return 1 - left


def test_scores_equal_plain_ones():
    rng = random.Random(12)
    terms = {"stupid": 0.95, "scoundrel": 0.9, "rot": 0.6, "vileword": 0.8}
    parts = ["you", "calm", "man", '"', "\n", "said", "stupid", "stuipd", "st0pid", "stup1d", "stupidd", "scoundrel", "scuondrle", "sc0undre1", "rot", "r0t", "stuuuupid", "vilewod", "violeword", "word", "2024", "1337"]
    scorer = tx.Scorer(tx.Model(terms))
    for _ in range(1500):
        text = " ".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert scorer.score(text) == pytest.approx(plain_score(terms, text)), text


def test_disguises_and_quotation():
    score = tx.Scorer(tx.Model({"stupid": 0.95, "disgusting": 0.95})).score
    for text in ("you stup1d man", "you $tupid man", "you s.t.u.p.i.d man", "you s t u p i d", "you stuuupid man", "Stop!Stupid"):
        assert score(text) >= 0.7, text
    for text in ("you stuipd man", "you st0pid man", "you st*pid man", "you stpid man", "so digusing"):
        assert 0.25 < score(text) < 0.7, text
    assert score("you stuipd and stpid man") >= 0.7
    assert score('"Hi" you stupid man "bye"') >= 0.7 and score('she wrote "you stupid man" there') < 0.7 and score('an open " mark\nyou stupid man\nand " there') >= 0.7
    assert score("„du stupid“ hieß es") < 0.7 and score("«stupid» et") < 0.7 and score("a b c d e f") == 0 and score("12 $100 a@b.example") == 0
    assert score(None) == score("") == score("\n\n") == 0 and score("calm " * 300_000 + "stupid") == pytest.approx(0.95)


def test_ties_tables_and_names(spark):
    rows = [("calm words here", "x"), ("calm words here", "x"), (None, "x"), ("you vileword", "x")]
    df = spark.createDataFrame(rows, "text string, toxicity string")
    out, c = tx.with_toxicity(df, tx.Model({"vileword": 0.9}))
    assert c == "_toxicity" and sorted(r[c] for r in out.collect()) == [0, 0, 0, pytest.approx(0.9)]
    assert tx.with_toxicity(df.limit(0), tx.Model())[0].count() == 0
    empty = spark.createDataFrame([], "body string, mark int, word string, t int")
    assert tx.learn(empty, "body", "mark").terms == {}
    assert tx.Trie({"abcdeg": 0.9, "abcdef": 0.9}).near("abcdex") == ("abcdef", 1)
