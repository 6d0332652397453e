"""Licence scans: Dice coefficient of word bigrams against templates, in column expressions only.

A text is looked at as a whole and by paragraph, line and sentence, so that a notice inside other prose is compared
on its own.  Three exact bounds keep the work small.  A segment can reach the threshold t only

* if it has at least t / (2 - t) of the template's bigrams, so a text without any of the *anchor words* that cover
  more than the rest of them is skipped before anything is cut up;
* with a template whose number of bigrams is within a factor (2 - t) / t of its own;
* then the coefficient itself is taken: 2 * shared / (own + template's), over sets of bigrams.

Defined results: one row for each key and licence reached, with the best coefficient and the number of segments that
reach it; null and empty texts, texts of one word, and empty tables have no rows; rows that share a key are taken
together (null is a key); other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
# Wording of common notices, as published with the licences.
TEMPLATES = {
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "MIT (line)": "Released under the MIT License.",
    "MIT (licensed)": "Licensed under the MIT License.",
    "BSD (line)": "Released under the BSD License.",
    "GPL (line)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2 (line)": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL (line)": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "CC-BY (line)": "Licensed under CC BY 4.0.",
    "CC-BY-NC (line)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA (line)": "Licensed under CC BY-SA 4.0.",
    "CC-BY (sentence)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
               "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0 (header)": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                           "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
                           "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
                           "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
                           "specific language governing permissions and limitations under the License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
           "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
           "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
           "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
           "included in all copies or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
           "that the above copyright notice and this permission notice appear in all copies.",
    "GPL (header)": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                    "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
                    "version.",
}


# Words that say little about a text; they become anchors only where nothing else is left.
COMMON = set("the of and to in that is was for on with as by at be this are from or an it a not any all no".split())


def words_of(text: str) -> list[str]:
    return re.sub(r"[^\w]+|_", " ", text.lower()).split()


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def anchor_words(templates: dict[str, str], threshold: float) -> list[str]:
    """Few words such that a segment that reaches the threshold with any template holds at least one of them."""
    chosen: set[str] = set()
    for text in templates.values():
        pairs = bigrams_of(text)
        must_miss = int(len(pairs) * (1 - threshold / (2 - threshold)) + 1e-9)  # so many may be absent
        counts: dict[str, int] = {}
        for pair in pairs:
            for word in set(pair.split()):
                counts[word] = counts.get(word, 0) + 1
        covered = {p for p in pairs if chosen & set(p.split())}
        for word in sorted(counts, key=lambda w: (w in COMMON, -len(w), w)):
            if len(covered) > must_miss:
                break
            if word not in chosen:
                chosen.add(word)
                covered |= {p for p in pairs if word in p.split()}
    return sorted(chosen)


def bigrams(segment: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(segment), r"[^\p{L}\p{N}]+", " ")), " ")
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words)),
                       lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))
    return F.array_distinct(F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))


def segments(text: Column) -> Column:
    """The text, its paragraphs, lines and sentences, each different string once."""
    parts = [F.array(text), F.split(text, r"\n\s*\n"), F.split(text, r"\n"), F.split(text, r"[.!?]\s+|\n")]
    return F.array_distinct(F.concat(*parts))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """key, license, score, segments."""
    templates = TEMPLATES if templates is None else templates
    body = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    anchors = "|".join(map(re.escape, anchor_words(templates, threshold)))
    hopeful = F.col("text").rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}])(?:{anchors})(?![\p{{L}}\p{{N}}])") if anchors else F.lit(False)
    known = F.array(*(F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, bigrams_of(t))).alias("pairs"), F.lit(len(bigrams_of(t))).alias("n"))
                      for name, t in templates.items()))
    cut = body.where(hopeful).select("key", F.explode(F.transform(segments(F.col("text")), bigrams)).alias("pairs"))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    size = F.size("pairs")
    plausible = F.filter(known, lambda t: (size >= t["n"] * low - 1e-9) & (size <= t["n"] * high + 1e-9))
    tried = cut.where(size > 0).select("key", "pairs", F.explode(plausible).alias("t"))
    score = 2.0 * F.size(F.array_intersect("pairs", F.col("t.pairs"))) / (F.size("pairs") + F.col("t.n"))
    scored = tried.select("key", F.col("t.name").alias("license"), score.alias("score")).where(F.col("score") >= threshold)
    return scored.groupBy("key", "license").agg(F.max("score").alias("score"), F.count("*").alias("segments")).withColumnRenamed("key", key)


def checking_sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """DuckDB: every segment against every template, without bounds."""
    templates = TEMPLATES if templates is None else templates
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(n)}, [{', '.join(map(quoted, bigrams_of(t)))}])" for n, t in templates.items())
    return rf"""
WITH known(license, pairs) AS (VALUES {known}),
cut AS (SELECT doc_id, unnest(list_distinct([text] || regexp_split_to_array(text, '\n\s*\n') || regexp_split_to_array(text, '\n')
        || regexp_split_to_array(text, '[.!?]\s+|\n'))) AS segment FROM documents WHERE text IS NOT NULL),
worded AS (SELECT doc_id, string_split(trim(regexp_replace(lower(segment), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS words FROM cut),
paired AS (SELECT doc_id, list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS pairs
           FROM worded WHERE len(words) > 1),
scored AS (SELECT p.doc_id, k.license, 2.0::DOUBLE * len(list_intersect(p.pairs, k.pairs)) / (len(p.pairs) + len(k.pairs)) AS score
           FROM paired p, known k)
SELECT doc_id, license, max(score) AS score, count(*) AS segments FROM scored WHERE score >= {threshold} GROUP BY doc_id, license"""
