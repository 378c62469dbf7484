"""Licence scans in DataFrame functions only.

Units of a text are compared with licence templates (notices as written in headers, and whole texts of short licences) by sparse TF-IDF cosine.  The
units are its lines and sentences, runs of two and three lines (notices are wrapped), blocks between blank lines (headers) and the whole text
(licence files).  A term's idf comes from all files scanned; terms that no template has weigh like an average one that templates have.

A unit can only reach ``THRESHOLD`` with a template if it shares terms that hold enough of the template's norm, so it holds at least one of the
template's rarer terms (those left when the most frequent ones, with less than the square of the threshold of the squared norm, are set aside).
It also needs enough of its own norm in terms that templates have.  Files and units that can't match by this are set aside unscored; nothing is lost.  Each distinct unit is scored once, however many files repeat it.

A file's own licence is that of its best unit at the threshold or more.  A file is a licence file if its name says so, if its whole text is such a
unit, or if half of its words lie in such lines and sentences; its licence holds for its directory, and files without one of their own take that of
the nearest ancestor directory.  Inheritance is worked out for distinct directories, then joined to the files.

Broadcast are the templates (a fixed list) and, only below ``BROADCAST_ROWS`` counted rows, distinct matched units and licensed directories; beyond
that the joins shuffle and Spark splits a hot line's or directory's rows.

Defined results: null and empty texts have no licence of their own but inherit; a null path has no directory and inherits from nothing; ties go to
the first licence, then the first path by name; repeated rows get equal rows; a very long text is one row and its units are scored like any others;
no files: no rows.  Only the named columns are read, so others can have any names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import let, materialise, release

THRESHOLD, BROADCAST_ROWS = 0.6, 200_000

#: Notices by licence, as commonly written in headers, titles and identifiers, and whole texts of short licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Use of this source code is governed by the BSD 2-clause license"),
    ("BSD-3-Clause", "Use of this source code is governed by the BSD 3-clause license"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "This work is dedicated to the public domain under the CC0 1.0 Universal license"),
    ("EPL-2.0", "Made available under the terms of the Eclipse Public License 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "You can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain under the Unlicense"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ Terms and conditions for use, reproduction, and distribution"),
    (
        "Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
        " http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS,"
        " WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    (
        "BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
        " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
        " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND"
        " FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
        " (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,"
        " STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
        " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
        " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
        " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
        " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND"
        " FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
        " (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT,"
        " STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    ("EPL-2.0", "SPDX-License-Identifier: EPL-2.0"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
        " THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."
        " IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,"
        " WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction,"
        " including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,"
        " subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
        " THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
        " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH"
        " THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,"
        " for any purpose, commercial or non-commercial, and by any means.",
    ),
)
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
UNIT_END, BLOCK_END = r"\n|\. ", r"\n[ \t\r]*\n"
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_terms() -> list[Counter[str]]:
    """The terms of each template with their numbers."""
    return [Counter(re.findall(TERM, text.lower())) for _, text in TEMPLATES]


def template_vectors(n_files: int, df: dict[str, int]) -> tuple[dict[str, float], list[tuple[int, str, str, float]], float, list[str]]:
    """idf by term; (template, licence, term, weight / norm); the weight of terms that no template has; the terms one of which a match needs."""
    own = template_terms()
    idf = {t: math.log((1 + n_files) / (1 + df.get(t, 0))) + 1 for t in sorted({t for c in own for t in c})}
    rows, needed = [], set()
    for k, ((licence, _), counts) in enumerate(zip(TEMPLATES, own, strict=True)):
        norm = math.sqrt(sum((c * idf[t]) ** 2 for t, c in counts.items()))
        parts = [(t, counts[t] * idf[t] / norm) for t in sorted(counts, key=lambda t: (idf[t], t))]
        rows += [(k, licence, t, x) for t, x in parts]
        aside = 0.0
        for t, x in parts:  # what most files have first
            aside += x * x
            if aside >= (THRESHOLD - 1e-3) ** 2:
                needed.add(t)
    return idf, rows, sum(idf.values()) / len(idf), sorted(needed)


def _folded(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def _terms(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(TERM), F.lit(0))


def _among(terms: list[str]) -> Column:
    return F.array(*(F.lit(t) for t in terms))


def _small(df: DataFrame) -> DataFrame:
    """With a broadcast hint if the (materialised) table has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def term_files(keyed: DataFrame) -> tuple[int, dict[str, int]]:
    """Files, and for each term of the templates the files that hold it; a row per such term reaches the driver."""
    terms = sorted({t for c in template_terms() for t in c})
    held = F.array_intersect(_terms(_folded(F.col("text"))), _among(terms))
    found = keyed.select(F.explode(held).alias("term")).groupBy("term").count().collect()
    return keyed.count(), {r["term"]: r["count"] for r in found}


def units_of(folded: Column) -> Column:
    """(kind, unit) of a text: 0 lines and sentences, 1 wider ones, 2 the whole."""
    lines = F.split(folded, "\n")

    def runs(own: Column) -> Column:
        return F.flatten(F.transform(F.array(F.lit(2), F.lit(3)), lambda n: F.transform(
            F.when(F.size(own) >= n, F.sequence(F.lit(1), F.size(own) - n + 1)).otherwise(F.array().cast("array<int>")), lambda i: F.array_join(F.slice(own, i, n), " "))))

    def kind(k: int, own: Column) -> Column:
        return F.transform(own, lambda u: F.struct(F.lit(k).alias("kind"), u.alias("unit")))

    return F.concat(kind(0, F.split(folded, UNIT_END)), kind(1, F.concat(let(lines, runs), F.split(folded, BLOCK_END))), kind(2, F.array(folded)))


def _may_match(terms: Column, vectors: tuple[dict[str, float], list, float, list[str]]) -> Column:
    """Whether a unit can reach the threshold: it holds a needed term, and enough of its own norm lies in terms that templates have.

    The weights of the latter are exact; the other terms count as if each stood once, which can only let too much pass.
    """
    idf, _, unknown, needed = vectors
    weights = F.create_map(*(F.lit(x) for t, w in sorted(idf.items()) for x in (t, w)))
    least = (THRESHOLD - 1e-3) ** 2

    def enough(own: Column) -> Column:
        def body(known: Column) -> Column:
            squares = F.transform(known, lambda t: F.pow(F.size(F.filter(own, lambda x: x == t)) * F.element_at(weights, t), F.lit(2.0)))
            others = F.size(F.array_distinct(own)) - F.size(known)
            return let(F.aggregate(squares, F.lit(0.0), lambda a, x: a + x), lambda v: v >= least * (v + others * unknown * unknown))

        return F.arrays_overlap(own, _among(needed)) & let(F.array_intersect(own, _among(sorted(idf))), body)

    return let(terms, enough)


def _unit_keys(unit: str = "unit") -> list[Column]:
    """128 bits that stand for a unit's text."""
    return [F.xxhash64(unit).alias("u1"), F.xxhash64(F.lit(1), unit, F.lit(1)).alias("u2")]


def matched_units(units: DataFrame, vectors: tuple[dict[str, float], list, float, list[str]]) -> DataFrame:
    """(unit, licence, score) of the distinct units at the threshold or more; ``units`` has the column unit."""
    spark = units.sparkSession
    idf, rows, unknown, _ = vectors
    weights = F.broadcast(spark.createDataFrame(sorted(idf.items()), "term string, idf double"))
    templates = F.broadcast(spark.createDataFrame(rows, "template int, licence string, term string, part double"))
    counts = units.where("unit <> ''").select("unit").distinct().select(*_unit_keys(), "unit")
    held = counts.select("u1", "u2", F.explode(_terms(F.col("unit"))).alias("term")).groupBy("u1", "u2", "term").count()
    weighted = materialise(held.join(weights, "term", "left").select("u1", "u2", "term", (F.col("count") * F.coalesce("idf", F.lit(unknown))).alias("w")))
    norms = weighted.groupBy("u1", "u2").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighted.join(templates, "term").groupBy("u1", "u2", "template", "licence").agg(F.sum(F.col("w") * F.col("part")).alias("dot"))
    scored = dots.join(norms, ["u1", "u2"]).select("u1", "u2", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= THRESHOLD)
    best = scored.groupBy("u1", "u2").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("best"))
    found = materialise(best.select("u1", "u2", F.col("best.licence").alias("licence"), (-F.col("best.s")).alias("score")))
    release(weighted)
    return found


def ancestors(directory: Column) -> Column:
    """The directory and all above it, down to the root (''), as (dir, depth)."""
    parts = F.when(directory == "", F.array().cast("array<string>")).otherwise(F.split(directory, "/"))
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, 1, n), "/").alias("dir"), n.alias("depth")))


def licence_scan(files: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """A row per file: path, text_hash, own_licence, own_score, is_licence_file, licence, inherited_from (the directory; null if its own)."""
    text = F.col(f"`{text_col}`")
    keyed = files.select(F.col(f"`{path_col}`").alias("path"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    vectors = template_vectors(*term_files(keyed))
    needed = _among(vectors[3])
    n_words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n_words")
    held = keyed.select("path", "text_hash", n_words, _folded(F.col("text")).alias("folded")).where(F.arrays_overlap(_terms(F.col("folded")), needed))
    every = held.select("path", "text_hash", "n_words", F.explode(units_of(F.col("folded"))).alias("u")).select("path", "text_hash", "n_words", "u.kind", "u.unit")
    every = every.withColumn("may", _may_match(_terms(F.col("unit")), vectors))
    # a file's whole text stays as a row, without its text where it can't match: rows are counted by it
    units = materialise(every.where("may OR kind = 2").select("path", "text_hash", "n_words", "kind", F.when(F.col("may"), F.col("unit")).otherwise(F.lit("")).alias("unit")))
    found = _small(matched_units(units, vectors))
    place = units.select("path", "text_hash", "n_words", "kind", *_unit_keys(), F.regexp_count("unit", F.lit(r"[^\x20\x09-\x0D]+")).alias("words"))
    hits = place.join(found, ["u1", "u2"])
    own = hits.groupBy("path", "text_hash").agg(
        F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("best"),
        F.sum(F.when(F.col("kind") == 0, F.col("words")).otherwise(0)).alias("words"), F.max("n_words").alias("n_words"), F.max(F.col("kind") == 2).alias("whole"),
    )
    # equal rows (same path and text) add their words up as often as their texts' words count once: compare shares per row
    copies = units.where("kind = 2").groupBy("path", "text_hash").agg(F.count("*").alias("copies"))
    own = own.join(copies.withColumnsRenamed({"path": "p", "text_hash": "h"}), F.col("path").eqNullSafe(F.col("p")) & (F.col("text_hash") == F.col("h")))
    most = 2 * F.col("words") >= F.col("n_words") * F.col("copies")
    own = materialise(own.select("path", "text_hash", F.col("best.licence").alias("own_licence"), (-F.col("best.s")).alias("own_score"), (F.col("whole") | most | F.coalesce(F.col("path").rlike(FILE_NAME), F.lit(False))).alias("is_licence_file")))
    release(units)
    directory = F.regexp_replace(F.regexp_replace("path", r"^/+", ""), r"/?[^/]*$", "")
    licensed = materialise(
        own.where("is_licence_file AND path IS NOT NULL")
        .groupBy(directory.alias("dir"))
        .agg(F.min(F.struct((-F.col("own_score")).alias("s"), "own_licence", "path")).alias("best"))
        .select("dir", F.col("best.own_licence").alias("dir_licence"))
    )
    places = keyed.where("path IS NOT NULL").select(directory.alias("place")).distinct()
    above = places.select("place", F.explode(ancestors(F.col("place"))).alias("a")).select("place", F.col("a.dir").alias("dir"), F.col("a.depth").alias("depth"))
    nearest = above.join(_small(licensed), "dir").groupBy("place").agg(F.max(F.struct("depth", "dir", "dir_licence")).alias("near"))
    inherited = _small(materialise(nearest.select("place", F.col("near.dir").alias("near_dir"), F.col("near.dir_licence").alias("near_licence"))))
    mine = own.withColumnsRenamed({"path": "p", "text_hash": "h"})
    out = keyed.select("path", "text_hash", directory.alias("place")).join(mine, F.col("path").eqNullSafe(F.col("p")) & (F.col("text_hash") == F.col("h")), "left").join(inherited, "place", "left")
    return out.select(
        "path", "text_hash", "own_licence", "own_score", F.coalesce("is_licence_file", F.lit(False)).alias("is_licence_file"),
        F.coalesce("own_licence", "near_licence").alias("licence"), F.when(F.col("own_licence").isNull(), F.col("near_dir")).alias("inherited_from"),
    )
