"""Licence phrases and templates in texts, by diagonal voting.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
All rolling ``GRAM``-word hashes of every text are joined to the positions of
the templates' grams (a fixed table of this module, so its broadcast is
bounded); hits vote for the diagonal (text position less template position),
neighbouring diagonals are merged, and a span is verified by the share of
template words that it covers.  The base phrases are found in the same words.

Edge cases: a null or empty text has no word and no label; repeated rows count
each for itself (their hits once); a null doc_id is kept; an empty table gives an
empty result; very long texts are read whole.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .runtime import bind, table, text_or_empty

GRAM = 3
#: Diagonals this near are one span (words put in or left out).
MERGE = 2
#: Share of template words that a verified span covers.
COVER = 0.75

# The base phrases with their labels, notices, and texts of public licences.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
See the GNU General Public License for more details."""),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means."""),
]

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def plain_words(text: Column) -> Column:
    """The words, A-Z lower-cased, joined by single spaces."""
    # of a text of ASCII alone, lower() changes A-Z and nothing else
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.trim(F.regexp_replace(low, _SEPARATORS, " "))


def words_of(text: str) -> list[str]:
    return [w for w in re.split(_SEPARATORS, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def _grams(words: Column) -> Column:
    """Hash of every ``GRAM`` consecutive words, in order."""

    def hashes(w: Column) -> Column:
        n = F.size(w) - (GRAM - 1)
        at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(GRAM)]))

    return bind(words, hashes)


def _places(words: Column, phrase: str) -> Column:
    """Starts of the phrase among the words."""
    parts = phrase.split(" ")

    def found(w: Column) -> Column:
        def here(i: Column) -> Column:
            test = F.lit(True)
            for j, p in enumerate(parts):
                test = test & (F.get(w, i + j) == p)
            return F.coalesce(test, F.lit(False))

        return F.filter(F.sequence(F.lit(0), F.size(w) - 1), here)

    return bind(words, found)


def template_grams(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """template, label, n_template, template_at, gram of every template position."""
    rows = [(i, label, words_of(text)) for i, (label, text) in enumerate(templates)]
    frame = spark.createDataFrame(rows, "template int, label string, w array<string>")
    return frame.select("template", "label", F.size("w").alias("n_template"), F.posexplode(_grams(F.col("w"))).alias("template_at", "gram"))


def template_spans(keyed: DataFrame, templates: DataFrame) -> DataFrame:
    """Verified spans of ``keyed`` (columns k1, k2, norm): k1, k2, label, cover, first_at, last_at."""
    grams = keyed.select("k1", "k2", F.posexplode(_grams(F.split("norm", " "))).alias("at", "gram"))
    hits = grams.join(F.broadcast(templates), "gram").select("k1", "k2", "template", "label", "n_template", "template_at", "at").distinct()
    votes = hits.groupBy("k1", "k2", "template", "label", "n_template", (F.col("at") - F.col("template_at")).alias("diagonal")).agg(F.collect_set("template_at").alias("seen"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    near = Window.partitionBy("k1", "k2", "template").orderBy("diagonal")
    new = F.when(F.col("diagonal") - F.lag("diagonal").over(near) <= MERGE, 0).otherwise(1)
    runs = votes.withColumn("new", new).withColumn("run", F.sum("new").over(near))
    spans = runs.groupBy("k1", "k2", "template", "label", "n_template", "run").agg(F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.min("lo").alias("first_at"), (F.max("hi") + GRAM - 1).alias("last_at"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("seen", lambda p: F.sequence(p, p + GRAM - 1)))))
    return spans.withColumn("cover", covered / F.col("n_template")).where(F.col("cover") >= COVER).select("k1", "k2", "label", "cover", "first_at", "last_at")


def scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    templates = template_grams(docs.sparkSession) if templates is None else templates
    text = text_or_empty(F.col("text"))
    rows = docs.select("doc_id", text.alias("t")).select("doc_id", F.col("doc_id").cast("string").alias("k1"), F.xxhash64("t").alias("k2"), plain_words(F.col("t")).alias("norm"))
    rows = rows.withColumn("k1", F.coalesce("k1", F.lit("")))
    padded = F.concat(F.lit(" "), F.col("norm"), F.lit(" "))
    places = [F.when(F.contains(padded, F.lit(f" {phrase} ")), _places(F.split("norm", " "), phrase)).otherwise(F.array().cast("array<int>")) for phrase in PHRASES]
    base = rows.select(
        "doc_id", "k1", "k2",
        F.when(F.col("norm") == "", 0).otherwise(F.length("norm") - F.length(F.replace("norm", F.lit(" "), F.lit(""))) + 1).cast("long").alias("n_words"),
        *[p.alias(f"p{i}") for i, p in enumerate(places)],
    )
    every = F.concat(*[F.col(f"p{i}") for i in range(len(places))])
    names = F.filter(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, label in enumerate(PHRASES.values())]), lambda x: x.isNotNull())
    base = base.select("doc_id", "k1", "k2", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_sort(F.array_distinct(names)).alias("base"))
    spans = template_spans(rows, templates).groupBy("k1", "k2").agg(F.collect_set("label").alias("more"), F.max("cover").alias("cover"))
    done = base.join(spans, ["k1", "k2"], "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("cover", F.lit(0.0)))
    return done.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
