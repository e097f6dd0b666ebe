"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block matches a template if it holds at least a given share of the template's
distinct words.  Blocks of a size serve the templates of up to half that size, so that a template's wording
always stands whole in a block.  Words are ordered by how many documents hold
them, rarest first.  A match must share one of a template's first |T| - need + 1
words (prefix filter), have enough words at all (length filter) and enough words
left in both after the first they share (position filter); what passes is counted.
All of it is DataFrame operations; texts are read and cut into words once.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.columns import row_keys, whole
from scriptorium.llm.common import written

#: Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Notices and texts of well-known licenses, (label, text).
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License."""),
    ("mit", "released under the MIT license"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE."""),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "This program is distributed under the GNU General Public License"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that
        it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU
        General Public License for more details. You should have received a copy of the GNU General Public License along with this program."""),
    ("lgpl", "redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
        are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
        ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
        DISCLAIMED."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
        above copyright notice and this permission notice appear in all copies."""),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
        file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
)

#: Blocks for the shortest templates have so many words, the next ones twice as many, and so on; they start at every half of that.
BLOCK = 64
#: All of ASCII that is not part of a word once A-Z are lower case.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: str = "text") -> Column:
    """A text's words, A-Z in lower case, joined by single spaces."""
    return F.trim(F.regexp_replace(F.translate(whole(text), UPPER, LOWER), GAPS, " "))


def _spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def phrase_places(docs: DataFrame, text: str = "text", keep_words: bool = False) -> DataFrame:
    """`docs` with n_words, n_base, first_word, last_word and base_labels (array) of the base phrases in the whole text.

    Null and empty texts have no words; first_word and last_word are null where no phrase stands.  Columns of
    these names are replaced.  With `keep_words`, __words is what `normal` makes of the text.
    Phrases never share a word, so one alternation finds all places.
    """
    pattern = "(?<= )(" + "|".join(PHRASES) + ")(?= )"
    names = F.create_map(*[F.lit(x) for pair in PHRASES.items() for x in pair])
    docs = docs.withColumn("__words", normal(text)).drop("n_words", "n_base", "first_word", "last_word", "base_labels")
    words = docs.withColumn("__joined", F.concat(F.lit(" "), "__words", F.lit(" ")))
    found = words.withColumn("__found", F.regexp_extract_all("__joined", F.lit(pattern), 1)).withColumn(
        "n_words", F.when(F.col("__words") == "", 0).otherwise(_spaces(F.col("__words")) + 1).cast("long")
    )
    gaps = F.when(F.size("__found") > 0, F.split("__joined", pattern, -1))
    last = F.element_at("__found", -1)
    return found.withColumn("__gaps", gaps).select(
        *[c for c in docs.columns if keep_words or c != "__words"],
        "n_words",
        F.size("__found").cast("long").alias("n_base"),
        (_spaces(F.element_at("__gaps", 1)) - 1).cast("long").alias("first_word"),
        F.when(F.size("__found") > 0, F.col("n_words") - _spaces(F.element_at("__gaps", -1)) + 1 - _spaces(last) - 1).cast("long").alias("last_word"),
        F.sort_array(F.array_distinct(F.transform("__found", lambda m: F.element_at(names, m)))).alias("base_labels"),
    )


def template_words(text: str) -> list[str]:
    """The words of a template, as `normal` has those of a text."""
    return re.sub(GAPS, " ", text.translate(str.maketrans(UPPER, LOWER))).split()


def block_sizes(templates: tuple[tuple[str, str], ...]) -> list[int]:
    """For each template, the size of the blocks that it is looked for in: the least that is twice its words."""
    out = []
    for _, text in templates:
        size = BLOCK
        while size < 2 * len(template_words(text)):
            size *= 2
        out.append(size)
    return out


def with_blocks(docs: DataFrame, threshold: float, templates: tuple[tuple[str, str], ...] = TEMPLATES, words: str = "__words") -> DataFrame:
    """`docs` with held, the template words that the text has, and blocks: array<struct<size, block, held>>, those with words enough for some template.

    A block starts at its word number `block`; they start at every half of a block, so any half of one stands whole in one.
    """
    sets = [set(template_words(t)) for _, t in templates]
    sizes = block_sizes(templates)
    vocabulary = F.array(*map(F.lit, sorted(set().union(*sets))))
    fewest = {size: min(max(1, math.ceil(threshold * len(x) - 1e-9)) for x, n in zip(sets, sizes, strict=True) if n == size) for size in set(sizes)}
    split = docs.withColumn("__split", F.split(words, " ")).withColumn("held", F.array_intersect(vocabulary, "__split"))

    def of(size: int) -> Column:
        step = size // 2
        starts = F.sequence(F.lit(0), F.greatest(F.size("__split") - step - 1, F.lit(0)), F.lit(step))
        every = F.transform(
            starts, lambda b: F.struct(F.lit(size).alias("size"), b.alias("block"), F.array_intersect(vocabulary, F.slice("__split", b + 1, size)).alias("held"))
        )
        none = F.array().cast("array<struct<size: int, block: int, held: array<string>>>")
        return F.when(F.size("held") >= fewest[size], F.filter(every, lambda x: F.size(x["held"]) >= fewest[size])).otherwise(none)

    return split.withColumn("blocks", F.concat(*map(of, sorted(fewest)))).drop("__split")


def document_frequencies(held: DataFrame) -> dict[str, int]:
    """held(held) -> how many documents hold each template word, over the whole table; what reaches the driver is bounded by the templates."""
    return {r["word"]: r["count"] for r in held.select(F.explode("held").alias("word")).groupBy("word").count().collect()}


def matches(blocks: DataFrame, often: dict[str, int], threshold: float, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """blocks(..., size, block, held) with template (its number), label and containment: every pair that reaches the threshold."""
    spark = blocks.sparkSession
    order = sorted(set().union(*(template_words(t) for _, t in templates)), key=lambda w: (often.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    index = []
    for i, ((label, text), size) in enumerate(zip(templates, block_sizes(templates), strict=True)):
        s = sorted(set(template_words(text)), key=rank.__getitem__)
        need = max(1, math.ceil(threshold * len(s) - 1e-9))
        index += [(token, size, i, label, at, len(s), need, s) for at, token in enumerate(s[: len(s) - need + 1])]
    values = ", ".join(f"('{t}', {z}, {i}, '{label}', {at}, {n}, {need}, array({', '.join(map(repr, s))}))" for t, z, i, label, at, n, need, s in index)
    index_df = F.broadcast(spark.sql(f"SELECT * FROM VALUES {values} AS t(token, size, template, label, t_at, t_size, need, t_words)"))  # bounded by the templates
    # array_intersect keeps the order of its first argument: the words of a block, rarest first
    named = [c for c in blocks.columns if c != "held"]
    ordered = blocks.select(*named, F.array_intersect(F.array(*map(F.lit, order)), "held").alias("held"))
    tokens = ordered.select(*named, "held", F.posexplode("held").alias("b_at", "token"))
    pairs = tokens.join(index_df, ["token", "size"]).where(
        (F.size("held") >= F.col("need"))
        & (F.col("t_size") - F.col("t_at") >= F.col("need"))
        & (F.size("held") - F.col("b_at") >= F.col("need"))
        & ~F.arrays_overlap("held", F.slice("t_words", F.lit(1), F.col("t_at")))  # the first shared word stands for the pair
    )
    shared = F.size(F.array_intersect("held", "t_words"))
    return pairs.where(shared >= F.col("need")).select(*named, "template", "label", (shared / F.col("t_size")).alias("containment"))


def license_labels(docs: DataFrame, threshold: float = 0.8, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every whole text.

    labels are those of phrases and of template blocks; score is 1 where a phrase
    stands, else the greatest containment of a template block, else 0.  Repeated
    rows have a row each; null ids stay null; empty texts have no blocks.  What
    the texts hold is written once, without the texts; frequencies and join read that.
    """
    placed = phrase_places(docs.select("doc_id", "text", *row_keys()), keep_words=True)
    scanned = written(with_blocks(placed, threshold, templates).drop("text", "__words"), "words")
    keys = ["k1", "k2"]
    blocks = scanned.select(*keys, F.inline("blocks"))
    found = matches(blocks, document_frequencies(scanned), threshold, templates)
    per_row = found.groupBy(*keys).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    labels = F.sort_array(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    return scanned.join(per_row, keys, "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
