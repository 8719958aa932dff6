"""Operator 2: licence scans by Dice coefficient over word bigrams (native).

A unit of text (a line, a paragraph, the whole text) is lower-cased and every run
of other characters than letters and digits becomes one space. A unit matches a
template if 2 |A and B| / (|A| + |B|) of their sets of word bigrams is at least
`threshold`. Sizes bound this from above, so only templates with a size within
t / (2 - t) and (2 - t) / t times the unit's are compared. Before that a unit must
hold one of a few telling words: of each template the words are chosen so that more
than 1 - t / (2 - t) of its bigrams hold one, which no match can do without.

A notice may also be a run of lines within a longer text or paragraph, of several
paragraphs too. A text that holds at least t / (2 - t) of a template's bigrams, as it
must for any part of it to match, is searched: from each line with a word of the
template, lines are added until the set is larger than the size bound, and the best end
is kept. Of overlapping runs of one licence the best stays, the first and shortest of
equals; it is a unit 'lines', numbered by its first line, unless it is a line,
paragraph or text, which are units of their own.

Defined cases: null or empty text has no unit and no match; one-word units have
no bigram; repeated bigrams count once; a unit that matches several licences has a row for
each, with its best template's score; every row of the input has its own matches, so repeated
rows, rows that share a doc_id and rows without one repeat theirs; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public licence notices, as their authors word them.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "LGPL-2.1": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["This work is dedicated to the public domain under CC0 1.0 Universal."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}

_BSD_DISCLAIMER = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_MIT_DISCLAIMER = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
TEMPLATES["MIT"].append(f"{TEMPLATES['MIT'][-1]} {_MIT_DISCLAIMER}")
for _name in ("BSD-2-Clause", "BSD-3-Clause"):
    TEMPLATES[_name].append(f"{TEMPLATES[_name][-1]} {_BSD_DISCLAIMER}")

THRESHOLD = 0.8
_COMMON = {"the", "of", "and", "to", "in", "a", "this", "is", "or", "with", "for", "by", "under", "at", "be", "you", "that", "it", "an", "on", "no", "as", "are", "if", "can", "not", "was", "any", "all", "one"}


def _words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams(text: str) -> set[str]:
    words = _words(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def telling_words(templates: dict[str, list[str]], threshold: float) -> list[str]:
    """Words of which every unit that matches a template must hold one."""
    needed = 1 - threshold / (2 - threshold)
    chosen: set[str] = set()
    for name in sorted(templates):
        for text in templates[name]:
            left = bigrams(text)
            most = (1 - needed) * len(left) - 1e-9
            left = {b for b in left if not chosen & set(b.split())}
            while len(left) >= most and left:
                counts = Counter(w for b in left for w in b.split())
                word = min(counts, key=lambda w: (w in _COMMON or len(w) < 3, -counts[w], w))
                chosen.add(word)
                left = {b for b in left if word not in b.split()}
    return sorted(chosen)


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]++", " "))


def _runs(template: Column, threshold: float) -> Column:
    """Runs (start, stop, score) of _lines, arrays of words, that match a template: of each first line the best."""
    n = template["n"]
    none = F.struct(F.expr("cast(array() as array<string>)").alias("grams"), F.lit("").alias("last"), F.lit(-1).alias("at"), F.lit(0.0).alias("score"), F.lit(-1).alias("stop"))

    def add(acc: Column, words: Column) -> Column:
        chain = F.when(acc["last"] == "", words).otherwise(F.concat(F.array(acc["last"]), words))
        more = F.when(F.size(chain) > 1, F.zip_with(F.slice(chain, F.lit(1), F.size(chain) - 1), F.slice(chain, F.lit(2), F.size(chain) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(none["grams"])
        grams = F.array_union(acc["grams"], more)
        after = F.struct(grams.alias("grams"), F.coalesce(F.get(words, F.size(words) - 1), acc["last"]).alias("last"), (acc["at"] + 1).alias("at"), acc["score"].alias("score"), acc["stop"].alias("stop"))

        def scored(x: Column) -> Column:
            score = F.size(F.array_intersect(x["grams"], template["grams"])) * 2.0 / (F.size(x["grams"]) + n)
            better = score > x["score"]
            return F.struct(x["grams"].alias("grams"), x["last"].alias("last"), x["at"].alias("at"), F.when(better, score).otherwise(x["score"]).alias("score"), F.when(better, x["at"]).otherwise(x["stop"]).alias("stop"))

        # A set that is too large stays so: nothing more is added.
        return F.when(F.size(acc["grams"]) > n * (2 - threshold) / threshold + 1e-9, acc).otherwise(F.get(F.transform(F.array(after), scored), F.lit(0)))

    starts = F.filter(F.sequence(F.lit(0), F.size("_lines") - 1), lambda i: F.arrays_overlap(F.get(F.col("_lines"), i), template["words"]))
    found = F.transform(starts, lambda i: F.aggregate(F.slice(F.col("_lines"), i + 1, F.size("_lines")), none, add, lambda acc: F.struct((-acc["score"]).alias("minus"), i.alias("start"), (acc["stop"] + i).alias("stop"))))
    return F.filter(found, lambda r: -r["minus"] >= threshold)


def _windows(docs: DataFrame, table: Column, pairs: Column, threshold: float, text: str) -> DataFrame:
    """(doc_id, unit, unit_no, license, score) of runs of lines that are no unit themselves; `pairs` are the bigrams of a column words."""
    # Each step is exploded as one row, so that no condition works it out again.
    once = lambda column, name: F.explode(F.array(column)).alias(name)
    every = F.array_distinct(F.flatten(F.transform(table, lambda t: t["grams"])))
    held = docs.select("doc_id", F.col(text), once(F.split(normalised(F.col(text)), " "), "words")).where(F.size("words") > 1)
    held = held.select("doc_id", F.col(text), once(F.array_intersect(pairs, every), "_hits")).where(F.size("_hits") > 0)
    least = threshold / (2 - threshold)
    near = F.filter(table, lambda t: (F.size("_hits") >= t["n"] * least - 1e-9) & (F.size(F.array_intersect("_hits", t["grams"])) >= t["n"] * least - 1e-9))
    held = held.select("doc_id", F.col(text), once(near, "_near")).where(F.size("_near") > 0)
    raw = F.split(F.col(text), "\n")
    held = held.select("doc_id", "_near", F.transform(raw, lambda x: F.filter(F.split(normalised(x), " "), lambda w: w != "")).alias("_lines"), F.transform(raw, lambda x: x.rlike(r"\A[ \t\r]*+\z")).alias("_blank"))
    named = F.transform(F.array_distinct(F.transform("_near", lambda t: t["license"])), lambda name: F.struct(name.alias("license"), F.array_sort(F.flatten(F.transform(F.filter("_near", lambda t: t["license"] == name), lambda t: _runs(t, threshold)))).alias("runs")))
    rows = held.select("doc_id", "_lines", "_blank", F.explode(named).alias("m"))
    apart = F.aggregate("m.runs", F.expr("cast(array() as array<struct<minus:double,start:int,stop:int>>)"), lambda acc, r: F.when(F.exists(acc, lambda x: (x["start"] <= r["stop"]) & (r["start"] <= x["stop"])), acc).otherwise(F.concat(acc, F.array(r))))
    rows = rows.select("doc_id", "_lines", "_blank", "m.license", F.explode(apart).alias("r"))
    part = lambda column, a, b: F.slice(F.col(column), a + 1, F.greatest(b - a, F.lit(0)))
    wordless = lambda a, b: F.forall(part("_lines", a, b), lambda x: F.size(x) == 0)
    start, stop, size = F.col("r.start"), F.col("r.stop") + 1, F.size("_lines")
    text_itself = wordless(F.lit(0), start) & wordless(stop, size)
    edge = lambda i: F.coalesce(F.get(F.col("_blank"), i), F.lit(True))
    paragraph = F.when(start > 0, edge(start - 1)).otherwise(True) & edge(stop) & ~F.exists(part("_blank", start, stop), lambda x: x)
    rows = rows.where((stop - start > 1) & ~text_itself & ~paragraph)
    return rows.select("doc_id", F.lit("lines").alias("unit"), start.alias("unit_no"), "license", (-F.col("r.minus")).alias("score"))


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs' columns doc_id, then unit ('line', 'paragraph', 'text', 'lines'), unit_no, license, score.

    One row for each unit and licence that match; no shuffle.
    """
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    table = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(len(grams)).alias("n"), F.array(*[F.lit(g) for g in sorted(grams)]).alias("grams"), F.array(*[F.lit(w) for w in sorted({w for g in grams for w in g.split()})]).alias("words")) for name in sorted(templates) for grams in map(bigrams, templates[name])])
    whole = F.array(F.struct(F.lit("text").alias("unit"), F.lit(0).alias("unit_no"), F.col(text).alias("part")))
    paragraphs = F.split(F.col(text), r"\n[ \t\r]*+\n")
    numbered = lambda kind, parts: F.transform(parts, lambda part, i: F.struct(F.lit(kind).alias("unit"), i.alias("unit_no"), part.alias("part")))
    lines = F.split(F.col(text), "\n")
    units = F.concat(
        numbered("line", lines),
        F.when((F.size(paragraphs) > 1) & (F.size(paragraphs) < F.size(lines)), numbered("paragraph", paragraphs)).otherwise(F.filter(whole, lambda _: F.lit(False))),
        F.when(F.size(lines) > 1, whole).otherwise(F.filter(whole, lambda _: F.lit(False))),
    )
    telling = r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(telling_words(templates, threshold)) + r")(?![\p{L}\p{N}])"
    held = docs.where(F.col(text).isNotNull() & F.col(text).rlike(telling))
    some = held.select("doc_id", F.explode(units).alias("u")).select("doc_id", "u.*")
    some = some.where(F.col("part").rlike(telling)).select("doc_id", "unit", "unit_no", F.split(normalised(F.col("part")), " ").alias("words"))
    pairs = F.expr("array_distinct(zip_with(slice(words, 1, size(words) - 1), slice(words, 2, size(words) - 1), (a, b) -> concat(a, ' ', b)))")
    some = some.where(F.size("words") > 1).withColumn("grams", pairs).withColumn("n", F.size("grams"))
    near = F.filter(table, lambda t: (t["n"] >= F.col("n") * low - 1e-9) & (t["n"] <= F.col("n") * high + 1e-9))
    scored = F.transform(near, lambda t: F.struct(t["license"].alias("license"), (F.size(F.array_intersect(F.col("grams"), t["grams"])) * 2.0 / (F.col("n") + t["n"])).alias("score")))
    # The best template of each licence, unit by unit: rows that share a doc_id stay apart, and nothing is exchanged.
    hits = some.select("doc_id", "unit", "unit_no", F.explode(F.array(F.filter(scored, lambda m: m["score"] >= threshold))).alias("hits")).where(F.size("hits") > 0)
    best = F.transform(F.array_distinct(F.transform("hits", lambda m: m["license"])), lambda name: F.struct(name.alias("license"), F.array_max(F.transform(F.filter("hits", lambda m: m["license"] == name), lambda m: m["score"])).alias("score")))
    matched = hits.select("doc_id", "unit", "unit_no", F.explode(best).alias("m")).select("doc_id", "unit", "unit_no", "m.license", "m.score")
    return matched.union(_windows(held.where(F.col(text).contains("\n")), table, pairs, threshold, text))


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs).select("doc_id", "unit", F.col("unit_no").cast("long").alias("unit_no"), "license", F.round("score", 9).alias("score"))


def _sql() -> str:
    rows = ", ".join(f"('{name}', '{g}', {k})" for k, (name, grams) in enumerate((n, bigrams(t)) for n in sorted(TEMPLATES) for t in TEMPLATES[n]) for g in sorted(grams))
    return rf"""
WITH t(license, gram, k) AS (VALUES {rows}),
sizes AS (SELECT k, license, count(*) AS n FROM t GROUP BY k, license),
docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL),
lines AS (SELECT r, doc_id, string_split(text, chr(10)) AS parts FROM docs),
paras AS (SELECT r, doc_id, regexp_split_to_array(text, '\n[ \t\r]*\n') AS parts, len(string_split(text, chr(10))) AS n_lines FROM docs),
units AS (
  SELECT r, doc_id, 'line' AS unit, generate_subscripts(parts, 1) - 1 AS unit_no, unnest(parts) AS part FROM lines
  UNION ALL SELECT r, doc_id, 'paragraph', generate_subscripts(parts, 1) - 1, unnest(parts) FROM paras WHERE len(parts) > 1 AND len(parts) < n_lines
  UNION ALL SELECT r, doc_id, 'text', 0, text FROM docs WHERE text LIKE '%' || chr(10) || '%'),
worded AS (SELECT r, doc_id, unit, unit_no, string_split(trim(regexp_replace(lower(part), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM units),
numbered AS (SELECT r, doc_id, unit, unit_no, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM worded),
grams AS (SELECT DISTINCT a.r, a.doc_id, a.unit, a.unit_no, a.word || ' ' || b.word AS gram FROM numbered a
  JOIN numbered b ON a.r = b.r AND a.unit = b.unit AND a.unit_no = b.unit_no AND b.i = a.i + 1),
held AS (SELECT g.r, g.doc_id, g.unit, g.unit_no, t.k, count(*) AS both_n FROM grams g JOIN t USING (gram) GROUP BY ALL),
total AS (SELECT r, unit, unit_no, count(*) AS n FROM grams GROUP BY ALL),
best AS (SELECT h.r, h.doc_id, h.unit, h.unit_no::BIGINT AS unit_no, s.license, round(max(2.0::DOUBLE * both_n / (u.n + s.n)), 9) AS score
  FROM held h JOIN sizes s USING (k) JOIN total u ON u.r = h.r AND u.unit = h.unit AND u.unit_no = h.unit_no
  WHERE 2.0::DOUBLE * both_n / (u.n + s.n) >= {THRESHOLD}::DOUBLE GROUP BY ALL)
SELECT doc_id, unit, unit_no, license, score FROM best
"""


OP2_SQL = _sql()
