"""Licence scans against a plain version that scores every unit, and the cases that single lines don't show."""

import math
import random
import re
from collections import Counter

from pairloom.llm import license_scan as ls


def plain(files):
    """(path, text) to (licence, score, whether a licence file) by scoring every unit with every template."""

    def fold(t):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def terms(t):
        return Counter(re.findall(ls.TERM, t))

    templates = [(x, terms(fold(t))) for x, t in ls.TEMPLATES]
    vocabulary = {t for _, c in templates for t in c}
    df = Counter(t for _, text in files if text is not None for t in set(terms(fold(text))) & vocabulary)
    idf = {t: math.log((1 + len(files)) / (1 + df[t])) + 1 for t in vocabulary}
    other = sum(idf.values()) / len(idf)

    def norm(c):
        return math.sqrt(sum((n * idf.get(t, other)) ** 2 for t, n in c.items()))

    out = {}
    for path, text in files:
        if text is None:
            continue
        body = fold(text)
        lines = body.split("\n")
        units = [(0, u) for u in re.split(ls.UNIT_END, body)] + [(1, u) for u in re.split(ls.BLOCK_END, body)] + [(2, body)]
        units += [(1, " ".join(lines[i : i + n])) for n in (2, 3) for i in range(len(lines) - n + 1)]
        best, words, whole = (0.0, ""), 0, False
        for kind, u in units:
            own = terms(u)
            scores = [(round(sum(n * idf[t] * own[t] * idf[t] for t, n in c.items()) / norm(c) / norm(own), 6), x) for x, c in templates] if own else []
            good = [(-score, x) for score, x in scores if score >= ls.THRESHOLD]
            if good:
                best = min(best, min(good))
                words += len(re.findall(r"[^\x20\x09-\x0D]+", u)) if not kind else 0
                whole = whole or kind == 2
        if best[1]:
            named = path is not None and re.search(ls.FILE_NAME, path) is not None
            out[path, text] = best[1], -best[0], whole or named or 2 * words >= len(re.findall(r"[^\x20\x09-\x0D]+", text))
    return out


def by_file(df):
    return {(r["path"], r["is_licence_file"]): r for r in df.collect()}


def test_every_unit_is_scored(spark):
    rng = random.Random(3)
    words = ["model", "license", "under", "the", "terms", "public", "mit", "free", "software", "general", "version", "3", "of", "code", "granted", "permission"]
    files = []
    for k in range(60):
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(1, 4))]
        if k % 2:
            notice = rng.choice(ls.TEMPLATES)[1].split()
            cut = notice[: rng.randint(max(2, len(notice) // 2), len(notice))]
            at = rng.randrange(len(cut))
            parts.insert(rng.randrange(len(parts) + 1), " ".join(cut[:at]) + rng.choice([" ", "\n * ", "\n\n"]) + " ".join(cut[at:]))
        files.append((f"a/{k}.txt", rng.choice(["\n", ". ", "\n\n"]).join(parts)))
    files += [("b/none.py", None), ("b/empty.py", ""), ("b/é.py", "plain words only, 日本")]
    got = {(r["path"]): (r["own_licence"], r["own_score"], r["is_licence_file"]) for r in ls.licence_scan(spark.createDataFrame(files, "path string, text string")).collect()}
    want = plain(files)
    assert len(got) == len(files) and len(want) > 20
    for path, text in files:
        licence, score, is_file = want.get((path, text), (None, None, False))
        assert (got[path][0], got[path][2]) == (licence, is_file) and (score is None or abs(got[path][1] - score) < 2e-6), path


def test_whole_texts_wrapped_headers_and_names(spark):
    bsd = next(t for x, t in ls.TEMPLATES if x == "BSD-3-Clause" and t.startswith("Redistribution"))
    wrapped = "# Licensed under the\n# Apache License,\n# Version 2.0\n\nimport os\n" + "x = 1\n" * 40
    files = [
        ("lib/LICENSE.txt", "Copyright (c) 2020 Somebody\n\n" + bsd.replace(". ", ".\n\n"), 1), ("lib/deep/er/code.py", "print(1)", 1), ("src/a.py", wrapped, 1), ("src/b.py", "Released under MIT", 1),
        ("src/c.py", "SPDX-License-Identifier: GPL-3.0-only", 1), ("src/d.py", "words " * 200_000 + "\nReleased under the MIT License", 1), ("src/d.py", "words " * 200_000 + "\nReleased under the MIT License", 1),
    ]
    files += [(f"prose/{k}.txt", f"a calm text about the weather, number {k}, and of nothing else at all", 1) for k in range(30)]
    df = spark.createDataFrame(files, "path string, text string, unit int").withColumnRenamed("path", "place").withColumnRenamed("text", "u")
    got = {r["path"]: r for r in ls.licence_scan(df, "place", "u").collect()}
    assert (got["lib/LICENSE.txt"]["licence"], got["lib/LICENSE.txt"]["is_licence_file"]) == ("BSD-3-Clause", True)
    assert (got["lib/deep/er/code.py"]["licence"], got["lib/deep/er/code.py"]["inherited_from"]) == ("BSD-3-Clause", "lib")
    assert got["src/a.py"]["licence"] == "Apache-2.0" and got["src/b.py"]["licence"] == "MIT" and got["src/c.py"]["licence"] == "GPL-3.0" and got["src/d.py"]["licence"] == "MIT"
    assert not got["src/d.py"]["is_licence_file"] and all(got[f"prose/{k}.txt"]["licence"] is None for k in range(30))
    assert ls.licence_scan(df.limit(0), "place", "u").count() == 0
