"""Licence scan: Dice coefficient over word bigrams; DataFrame functions only."""

from __future__ import annotations

import re
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramma.llm.common import documents, text_of

THRESHOLD = 0.8

# Public licence texts and notices, by SPDX identifier.
MIT_BODY = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"
)
BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_TWO = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
    "following disclaimer in the documentation and/or other materials provided with the distribution."
)
BSD_THIRD = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, "
    "OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
ISC_BODY = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
TEMPLATES = {
    "0BSD": f"{ISC_BODY}. {ISC_END}",
    "AGPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause": f"{BSD_HEAD}: 1. {BSD_TWO.replace('Redistributions in', '2. Redistributions in')} {BSD_END}",
    "BSD-3-Clause": f"{BSD_HEAD}: 1. {BSD_TWO.replace('Redistributions in', '2. Redistributions in')} 3. {BSD_THIRD} {BSD_END}",
    "BSD-3-Clause/line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "BSD-3-Clause/text": BSD_HEAD,
    "BSL-1.0/line": "Distributed under the Boost Software License, Version 1.0",
    "CC-BY-4.0/line": "Licensed under CC BY 4.0",
    "CC-BY-4.0/work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0/line": "Licensed under CC BY-SA 4.0",
    "CC0-1.0/notice": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty",
    "EPL-2.0/notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "GPL-2.0/line": "This program is licensed under the GNU General Public License, version 2",
    "GPL-2.0/notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0/notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "ISC": f"{ISC_BODY}, provided that the above copyright notice and this permission notice appear in all copies. {ISC_END}",
    "ISC/text": f"{ISC_BODY}, provided that the above copyright notice and this permission notice appear in all copies",
    "LGPL-2.1/line": "This library is licensed under the GNU Lesser General Public License, version 2.1",
    "LGPL-2.1/notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "MIT": (
        f"{MIT_BODY}: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
        "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "MIT/line": "Released under the MIT License",
    "MIT/licensed": "This project is licensed under the MIT License",
    "MIT/text": MIT_BODY,
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "Unlicense/text": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or "
        "non-commercial, and by any means."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, "
        "including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may "
        "not be removed or altered from any source distribution."
    ),
}


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[^\W_]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """Least and most bigrams of a passage whose Dice coefficient with n bigrams can reach the threshold."""
    low = next(a for a in range(n + 1) if 2 * min(a, n) >= threshold * (a + n))
    high = n
    while 2 * n >= threshold * (high + 1 + n):
        high += 1
    return low, high


def needed(bigrams: list[str], threshold: float) -> list[str]:
    """Bigrams of which a passage that reaches the threshold holds one.

    It shares at least s = ceil(t n / (2 - t)) of the template's n bigrams, so any
    n - s + 1 of them will do; the longest are the rarest.
    """
    n = len(bigrams)
    shared = next(s for s in range(n + 1) if s * (2 - threshold) >= threshold * n - 1e-9)
    return sorted(bigrams, key=lambda b: (-len(b), b))[: n - shared + 1]


def any_of(phrases: list[str]) -> str:
    """A pattern that finds a blank and any of the phrases; by their first two letters, so that few are tried at a place."""
    heads: dict[str, list[str]] = {}
    for p in phrases:
        heads.setdefault(p[:2], []).append(p[2:])
    return " (?:" + "|".join(f"{head}(?:{'|'.join(map(re.escape, tails))})" for head, tails in sorted(heads.items())) + ") "


def passages(text: Column) -> Column:
    """Sentences and lines of a text, then its blocks between blank lines, normalised."""
    sentences = F.split(F.regexp_replace(text, r"([.!?;:])[ \t]+", "$1\n"), r"[\r\n]+")
    blocks = F.split(text, r"\r?\n[ \t]*\r?\n[\s]*")
    return F.concat(sentences, blocks)


def scan_license_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Passages of whole texts that match a licence template: the simpler scan, which SQL can express.

    Each text falls into sentences and lines, and into blocks between blank
    lines. Normalised (lower case, runs of letters and digits), a passage meets a
    template if the Dice coefficient of their sets of word bigrams reaches the
    threshold. A passage that holds none of the bigrams without which no template
    can be matched is passed over, and size bounds prune templates; both are exact.

    One row per passage and template: id, ``place`` (number of the passage),
    ``template``, ``dice``. Texts that are null, empty or without a match give no
    row; repeated rows are scanned each; other columns are ignored. No shuffle.
    """
    grams = {name: template_bigrams(t) for name, t in (templates or TEMPLATES).items()}
    anchors = sorted({a for g in grams.values() for a in needed(g, threshold)})
    rows = docs.select(F.col(id_col).alias("_id"), F.posexplode(passages(text_of(text_col))).alias("place", "_passage"))
    lowered = F.concat(F.lit(" "), F.regexp_replace(F.lower("_passage"), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    rows = rows.select("_id", "place", lowered.alias("_norm")).where(F.col("_norm").rlike(any_of(anchors)))
    words = F.split(F.trim("_norm"), " +")
    pairs = F.array_distinct(F.transform(F.slice("_words", F.lit(1), F.greatest(F.size("_words") - 1, F.lit(0))), lambda w, i: F.concat(w, F.lit(" "), F.get("_words", i + 1))))
    rows = rows.withColumn("_words", words).withColumn("_pairs", pairs).withColumn("_n", F.size("_pairs"))

    def dice(name: str) -> Column:
        g, (low, high) = grams[name], size_bounds(len(grams[name]), threshold)
        shared = F.size(F.array_intersect("_pairs", F.array(*map(F.lit, g))))
        return F.when(F.col("_n").between(low, high), F.struct(F.lit(name).alias("template"), (2.0 * shared / (F.col("_n") + len(g))).alias("dice")))

    found = rows.select("_id", "place", F.explode(F.array_compact(F.array(*map(dice, grams)))).alias("_m"))
    return found.select(F.col("_id").alias(id_col), "place", "_m.template", "_m.dice").where(F.col("dice") >= threshold)


def window_sizes(text: str, threshold: float) -> tuple[int, int, int]:
    """Least shared bigrams, and least and most bigram places of a window that can reach the threshold.

    A template that repeats bigrams takes more places than it has distinct bigrams; its windows may too.
    """
    n = len(template_bigrams(text))
    low, high = size_bounds(n, threshold)
    shared = next(s for s in range(n + 1) if s * (2 - threshold) >= threshold * n - 1e-9)
    return shared, low, high + len(re.findall(r"[^\W_]+", text)) - 1 - n


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Places of whole texts that match a licence template, wherever lines, sentences and comments begin and end.

    The text is one row of words (lower case, runs of letters and digits; so
    line ends and comment leaders such as ``*``, ``//`` and ``#`` fall away, and ``rem`` and
    ``dnl`` at a line's start are dropped). Every window of ``window_sizes`` places is
    compared with the template by the Dice coefficient of their word bigrams; bigrams that the template has count once, others as
    often as they occur. Only windows that begin and end with a bigram of the
    template are formed: cutting another off its edge never lowers the coefficient. A text that holds none of the bigrams without
    which no template can be matched is passed over, and size bounds prune templates; both are exact.
    Of the windows from one place the best counts, then the shortest; of those that overlap, the best stays, then the first.

    One row per place and template: id, ``start`` (number of the window's first
    word), ``n_words``, ``template``, ``dice``. Texts that are null, empty or without a match
    give no row; repeated rows are scanned each; other columns are ignored. No shuffle.
    """
    named = templates or TEMPLATES
    grams = {name: template_bigrams(t) for name, t in named.items()}
    anchors = sorted({a for g in grams.values() for a in needed(g, threshold)})
    bare = F.regexp_replace(text_of(text_col), r"(?im)^[ \t]*@?(?:rem|dnl)[ \t]", " ")
    norm = F.concat(F.lit(" "), F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    rows = docs.select(F.col(id_col).alias("_id"), norm.alias("_norm")).where(F.col("_norm").rlike(any_of(anchors)))
    rows = rows.select("_id", F.split(F.trim("_norm"), " +").alias("_words"))
    rows = rows.select("_id", F.transform(F.slice("_words", F.lit(1), F.size("_words") - 1), lambda w, i: F.concat(w, F.lit(" "), F.get("_words", i + 1))).alias("_pairs"))

    def template(name: str) -> Column:
        shared, low, most = window_sizes(named[name], threshold)
        values = {"shared": shared, "low": low, "most": most, "n": len(grams[name])}
        made = F.struct(F.lit(name).alias("name"), F.array(*map(F.lit, grams[name])).alias("grams"), *[F.lit(v).alias(k) for k, v in values.items()])
        return F.when(F.arrays_overlap("_pairs", F.array(*map(F.lit, needed(grams[name], threshold)))), made)

    rows = rows.select("_id", "_pairs", F.explode(F.array_compact(F.array(*map(template, grams)))).alias("_t"))
    marked = F.transform("_pairs", lambda g, i: F.struct(i.alias("p"), F.array_position(F.col("_t.grams"), g).cast("int").alias("k")))
    rows = rows.select("_id", "_t", F.filter(marked, lambda h: h["k"] > 0).alias("_hits"))

    def again(h: Column, i: Column) -> Column:
        """A hit with the place where its bigram stood last, as far as a window reaches."""
        reach = F.least(i, F.col("_t.most"))
        same = F.filter(F.slice("_hits", i - reach + 1, reach), lambda y: y["k"] == h["k"])
        return F.struct(h["p"].alias("p"), F.coalesce(F.array_max(F.transform(same, lambda y: y["p"])), F.lit(-1)).alias("last"))

    rows = rows.where(F.size("_hits") >= F.col("_t.shared")).withColumn("_hits", F.transform("_hits", again))

    def best_from(h: Column, i: Column) -> Column:
        """The best window that begins with a hit: hits are taken in turn, and all that counts is counted on."""
        near = F.filter(F.slice("_hits", i + 1, F.col("_t.most")), lambda x: x["p"] < h["p"] + F.col("_t.most"))
        start = F.struct(F.lit(0).alias("shared"), F.lit(0).alias("hits"), F.lit(0.0).alias("dice"), F.lit(0).alias("n"))

        def longer(so_far: Column, x: Column) -> Column:
            shared, hits, length = so_far["shared"] + (x["last"] < h["p"]).cast("int"), so_far["hits"] + 1, x["p"] - h["p"] + 1
            fits = (shared >= F.col("_t.shared")) & (length >= F.col("_t.low"))
            dice = F.when(fits, 2.0 * shared / (length - hits + shared + F.col("_t.n"))).otherwise(0.0)
            return F.struct(shared.alias("shared"), hits.alias("hits"), F.greatest(dice, so_far["dice"]).alias("dice"), F.when(dice > so_far["dice"], length).otherwise(so_far["n"]).alias("n"))

        return F.when(F.size(near) >= F.col("_t.shared"), F.aggregate(near, start, longer, lambda w: F.struct((-w["dice"]).alias("d"), h["p"].alias("p"), w["n"].alias("n"))))

    def keep(kept: Column, x: Column) -> Column:
        return F.when(F.exists(kept, lambda y: (x["p"] <= y["p"] + y["n"]) & (y["p"] <= x["p"] + x["n"])), kept).otherwise(F.array_append(kept, x))

    found = F.array_sort(F.filter(F.array_compact(F.transform("_hits", best_from)), lambda w: w["d"] <= -threshold))
    best = F.aggregate(found, F.array().cast("array<struct<d:double,p:int,n:int>>"), keep)
    rows = rows.select("_id", "_t.name", F.explode(best).alias("_m"))
    return rows.select(F.col("_id").alias(id_col), F.col("_m.p").alias("start"), (F.col("_m.n") + 1).alias("n_words"), F.col("name").alias("template"), (-F.col("_m.d")).alias("dice"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))


def op9_license_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_license_lines(documents(spark, sf_dir))


def _oracle() -> str:
    values = ", ".join("('{}', '{}')".format(name, " ".join(re.findall(r"[^\W_]+", t.lower()))) for name, t in TEMPLATES.items())
    return rf"""
WITH p AS (
  SELECT doc_id, coalesce(text, '') AS t,
    list_concat(
      string_split_regex(regexp_replace(coalesce(text, ''), '([.!?;:])[ \t]+', '\1' || chr(10), 'g'), '[\r\n]+'),
      string_split_regex(coalesce(text, ''), '\r?\n[ \t]*\r?\n[\s]*')) AS parts
  FROM documents
), u AS (
  SELECT doc_id, (unnest(range(len(parts))))::INT AS place, unnest(parts) AS part FROM p
), w AS (
  SELECT doc_id, place, string_split(trim(regexp_replace(lower(part), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS words FROM u
), b AS (
  SELECT doc_id, place, list_distinct([words[i] || ' ' || words[i + 1] for i in range(1, len(words))]) AS pairs FROM w
), t0 AS (SELECT * FROM (VALUES {values}) v(template, body)),
t AS (
  SELECT template, list_distinct([x[i] || ' ' || x[i + 1] for i in range(1, len(x))]) AS grams
  FROM (SELECT template, string_split(body, ' ') AS x FROM t0)
), m AS (
  SELECT doc_id, place, template, 2.0::DOUBLE * len(list_intersect(pairs, grams)) / (len(pairs) + len(grams)) AS dice
  FROM b, t WHERE len(pairs) > 0
)
SELECT doc_id, place, template, dice FROM m WHERE dice >= {THRESHOLD}
"""


OP9_SQL = _oracle()
