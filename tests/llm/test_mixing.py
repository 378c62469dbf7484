"""The exact schedule against its target, and the rows that follow it."""

import random
from fractions import Fraction

import pytest

from pairloom.llm import mixing


def furthest(blocks, weights):
    """The schedule is whole, and the largest deviation of a source from the fluid mixture by its original weights."""
    n = {s: k for s, k in blocks.items() if k}
    w = {s: Fraction(weights[s]) for s in n}
    got, target, seen, worst = dict.fromkeys(n, 0), dict.fromkeys(n, Fraction(0)), 0, 0
    for s, k in mixing.fluid_slots(blocks, weights):
        assert k == got[s]
        got[s], left = got[s] + 1, Fraction(1)
        while left:
            live = [x for x in n if target[x] < n[x]]
            total = sum(w[x] for x in live)
            step = min(left, *((n[x] - target[x]) * total / w[x] for x in live))
            for x in live:
                target[x] += step * w[x] / total
            left -= step
        seen += 1
        worst = max(worst, *(abs(got[x] - target[x]) for x in n))
    assert got == n and seen == sum(n.values())
    return worst


def test_exact_schedule_stays_within_a_block():
    rng = random.Random(7)
    for _ in range(60):
        sources = "abcdefgh"[: rng.randint(1, 8)]
        blocks, weights = {s: rng.randint(0, 60) for s in sources}, {s: rng.uniform(0.05, 9) for s in sources}
        if any(blocks.values()):
            assert furthest(blocks, weights) < 1


def test_exact_schedule_stays_within_a_block_for_long():
    sizes = [150_000, *(30_000 - 1700 * k for k in range(10)), 40]
    blocks, weights = {f"s{k:02}": n for k, n in enumerate(sizes)}, {f"s{k:02}": n**0.5 for k, n in enumerate(sizes)}
    weights["s11"] = sum(weights.values()) * 0.0004
    total, got, worst, slots = sum(weights.values()), dict.fromkeys(blocks, 0), 0.0, 0
    # before any source is used up, the target is a slot's number times the weight
    until = int(min(n * total / weights[s] for s, n in blocks.items()))
    for t, (s, _) in enumerate(mixing.fluid_slots(blocks, weights), 1):
        got[s], slots = got[s] + 1, t
        if t <= until and t % 7 == 0:
            worst = max(worst, *(abs(got[x] - t * weights[x] / total) for x in got))
    assert slots == sum(sizes) > 300_000 and until > 50_000 and got == blocks
    assert worst < 1


@pytest.mark.parametrize("chunk", [7, 500_000])
def test_rows_get_the_slots_of_their_blocks(spark, monkeypatch, chunk):
    monkeypatch.setattr(mixing, "CHUNK_SLOTS", chunk)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 10)
    docs = spark.createDataFrame([(k, "abc"[min(k % 5, 2)], "x" * (1 + 37 * k % 400)) for k in range(300)], "doc_id bigint, source string, text string")
    weights = {"a": 0.0004, "b": 0.3, "c": 0.6996}
    out = mixing.mixed(docs, weights, block_bytes=128).collect()
    assert len(out) == 300
    size = {}
    for r in out:
        size[r["source"]] = size.get(r["source"], 0) + len(r["text"])
    want = {x: t for t, x in enumerate(mixing.fluid_slots({s: -(-n // 128) for s, n in size.items()}, weights))}
    assert all(r["mix_slot"] == want[r["source"], r["mix_block"]] for r in out)


def test_thousands_of_sources(spark):
    docs = spark.createDataFrame([(k, f"host{k % 2500}", "x" * (k % 90)) for k in range(6000)], "doc_id bigint, source string, text string")
    out = mixing.mixed(docs, block_bytes=64).collect()
    assert len(out) == 6000
    blocks = {(r["source"], r["mix_block"]): r["mix_slot"] for r in out}
    assert len({r["source"] for r in out}) == 2500 and len(set(blocks.values())) == len(blocks) and None not in blocks.values()


def test_copies_and_clashing_names(spark):
    """A hot row that fills many blocks is spread over them; names of the plan's own columns may stand in the table."""
    rows = [(7, "a", "x" * 50)] * 300 + [(k, "ab"[k % 2], "y" * (k % 90)) for k in range(200)] + [(900, None, None), (901, "", ""), (902, "b", "z" * 5000)]
    docs = spark.createDataFrame([(*r, k, "s", k) for k, r in enumerate(rows)], "doc_id bigint, source string, text string, key int, s string, slot int").withColumnsRenamed({"slot": "mix_key"}).withColumnRenamed("key", "slot_block")
    out = mixing.mixed(docs, block_bytes=128)
    assert out.columns == [*docs.columns, "mix_slot", "mix_block", "mix_start"]
    got = out.collect()
    assert sorted(r["mix_key"] for r in got) == list(range(len(rows))) and all(r["mix_slot"] is not None for r in got)
    hot = [r["mix_block"] for r in got if r["doc_id"] == 7]
    assert len(set(hot)) > 70 and 100 < max(hot) - min(hot) <= 117  # 300 rows of 50 bytes in blocks of 128
    slots = {}
    for r in got:
        slots.setdefault((r["source"] or "", r["mix_block"]), set()).add(r["mix_slot"])
    assert all(len(x) == 1 for x in slots.values())
    total = sum(len(t or "") or 1 for _, s, t in rows if s == "a")
    assert max(r["mix_start"] for r in got if r["source"] == "a") < total
    assert mixing.mixed(docs.limit(0)).count() == 0


def test_places_follow_each_other(spark, monkeypatch):
    """Without repeated rows the places of a source are its documents end to end."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 15)
    docs = spark.createDataFrame([(k, "ab"[k % 3 == 0], "w" * (1 + k * 31 % 200)) for k in range(400)], "doc_id bigint, source string, text string")
    by = {}
    for r in mixing.mixed(docs).collect():
        by.setdefault(r["source"], []).append((r["mix_start"], len(r["text"])))
    for own in by.values():
        at = 0
        for start, size in sorted(own):
            assert start == at
            at += size
