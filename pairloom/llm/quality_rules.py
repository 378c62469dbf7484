"""Quality rules as a bitmask ledger.

Each text is measured once and every rule evaluated once; a failed rule sets its bit.  The ledger (ids, measurements and bits, without texts) is
written down once, and a policy is only a named, versioned mask of bits: applying another policy, or asking what a policy would do without one of its
rules, is a bitwise aggregation over the ledger and reads no text again.

Letters are those of any script (Unicode letters and their marks), capitals are upper-case letters of any script.

Defined results: null and empty texts have no words, all measures 0, and fail ``few_words``; a measure that equals a limit doesn't fail it; repeated
rows get equal rows; lines and words are those of the whole text whatever its length; an empty table gives an empty ledger, whose ablation is all 0.
Only the named columns are read, so extra columns and clashing names don't matter.
"""

from __future__ import annotations

import unicodedata
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import materialise, unused_name

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper")
LEDGER = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"

#: Rule name to (bit, SQL condition of failure).  All comparisons are of integers, so every engine agrees.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 50"),
    "repeated_words": (1, "100 * n_repeat_words > 50 * n_words"),
    "symbols": (2, "4 * n_symbols > n_words"),
    "upper_case": (3, "n_letters > 0 AND 2 * n_upper > n_letters"),
    "dup_lines": (4, "n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines"),
    "short_words": (5, "n_words > 0 AND word_chars < 2 * n_words"),
    "long_words": (6, "word_chars > 20 * n_words"),
    "few_letters": (7, "2 * n_letters < word_chars"),
}
BASE = ("few_words", "repeated_words")
#: Versioned policies: the rules that reject.
POLICIES: dict[str, tuple[str, ...]] = {"base-1": BASE, "form-1": (*BASE, "symbols", "upper_case", "dup_lines"), "strict-1": tuple(RULES)}


def mask(names: tuple[str, ...]) -> int:
    return sum(1 << RULES[n][0] for n in names)


_SPACE = np.zeros(128, bool)
_SPACE[[32, *range(9, 14)]] = True
_SYMBOL = np.zeros(128, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


@cache
def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter (or its mark), and whether an upper-case one."""
    kinds = np.array([unicodedata.category(chr(c)) for c in range(0x110000)])
    return np.char.startswith(kinds, "L") | np.char.startswith(kinds, "M"), kinds == "Lu"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    ids: dict[bytes, int] = {}
    fresh = count()
    w = np.fromiter((ids[x] if x in ids else ids.setdefault(x, next(fresh)) for x in words), np.int64, n)
    k = len(ids)
    if k < 2_000_000:  # three ids fit one 63-bit number exactly
        key = (w[:-2] * k + w[1:-1]) * k + w[2:]
    else:
        pair = np.unique(w[:-1] * k + w[1:], return_inverse=True)[1]
        key = pair[:-1] * k + w[2:]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = twice.copy()
    hit[1:] |= twice[:-1]
    hit[2:] |= twice[:-2]
    return int(hit.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measures of one text, in the order of MEASURES."""
    if not text:
        return (0,) * len(MEASURES)
    raw = text.encode()
    words = raw.split()  # ASCII white space: exactly 0x20 and 0x09-0x0D
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    low = cp[cp < 128]
    letter, upper = _classes()
    spaces = int(_SPACE[low].sum())
    lines, seen, dup = 0, set(), 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return (len(words), len(cp) - spaces, int(_SYMBOL[low].sum()), dup, repeated_words(words), lines, int(letter[cp].sum()), int(upper[cp].sum()))


def _measured(text: pa.Array) -> pa.Array:
    rows = [measure(t) for t in text.to_pylist()]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(MEASURES)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], list(MEASURES))


def rule_bits(measures: str) -> Column:
    """The bits of the failed rules, from a struct of measures."""
    bits = F.lit(0).cast("bigint")
    for bit, condition in RULES.values():
        bound = " ".join(f"{measures}.{w}" if w in MEASURES else w for w in condition.split(" "))
        bits = bits.bitwiseOR(F.when(F.expr(bound), F.lit(1 << bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return bits


def with_ledger(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with its ledger: a struct of measures and the rule bits.  Narrow; returns the frame and the two names."""
    m = unused_name(docs, "quality_measures")
    b = unused_name(docs, "quality_bits")
    out = docs.withColumn(m, F.arrow_udf(_measured, LEDGER).asNondeterministic()(F.col(f"`{text_col}`")))
    return out.withColumn(b, rule_bits(m)), m, b


def stored_ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger of ``docs`` written down: id, the measures, rule_bits; a row per row."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ledger, m, bits = with_ledger(own)
    return materialise(ledger.select("doc_id", *(F.col(f"{m}.{c}").alias(c) for c in MEASURES), F.col(bits).alias("rule_bits")))


def passes(bits: str, policy: str = "strict-1") -> Column:
    """Whether a row of the ledger passes a policy."""
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablation(ledger: DataFrame, bits: str, policy: str = "strict-1") -> DataFrame:
    """For each rule of a policy: the rows that fail it, and those that only it rejects.

    One pass of conditional sums over the bits; one row per rule.  An empty ledger gives zeros.
    """
    own, held = F.col(bits), mask(POLICIES[policy])
    sums = []
    for name in POLICIES[policy]:
        one = 1 << RULES[name][0]
        sums += [
            F.coalesce(F.count_if(own.bitwiseAND(F.lit(one)) != 0), F.lit(0)).alias(f"{name}__failed"),
            F.coalesce(F.count_if(own.bitwiseAND(F.lit(held)) == one), F.lit(0)).alias(f"{name}__alone"),
        ]
    wide = ledger.agg(*sums)
    return wide.select(F.inline(F.array(*(F.struct(F.lit(policy).alias("policy"), F.lit(n).alias("rule"), F.col(f"{n}__failed").alias("failed"), F.col(f"{n}__alone").alias("only_this")) for n in POLICIES[policy]))))
