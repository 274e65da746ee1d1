"""Licence scan: normalised text against licence templates by Dice over word bigrams.

A text is lower-cased and reduced to words of a-z and 0-9.  Its units are each line, each sentence of a
line, each run of lines between empty lines (a notice that is wrapped over lines), each two and
three such runs in a row, and the whole text; equal units of a text count once.  With A
and B the sets of word bigrams of unit and template, the measure is 2|A n B| / (|A| + |B|).
For it to reach `least`, the sizes must satisfy
least / (2 - least) <= |A| / |B| <= (2 - least) / least, so each unit is only
compared with templates within these bounds.  A unit that reaches `least` also holds most of
the template's bigrams, and so one of a few anchor words; documents and units without any are
dropped before bigrams are made.

Licences come in versions and variants whose notices differ in few words.  Templates of different licences with a
measure of `NEAR` or more are neighbours, and a unit must hold more than half of the bigrams that a template has and a neighbour has not, for each of
its neighbours; so a version that is not listed is not taken for one that is.  A unit that says not to be licensed or released is
left out.  A licence that another one holds with more (two clauses of three) is not reported beside it for the same text.  A unit goes to the template it is closest to (to all, if several are equally close).  Whole texts of the long licences are not listed, their notices are.

All of it is DataFrame functions: units are exploded into bigrams, joined with the
bigrams of the fixed template list (a broadcast of constant size), and counted by
unit and template.  A hot source or a frequent line is only many small groups.

Null and empty texts have no match.  Each document comes back once, with the licences it
matches and the best measure; rows of equal id come together as one, and the units of each
row count, of equal rows too.  A null id is an id of its own.  \\r, \\n and \\r\\n end lines.  Only id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Licence notices and whole licence texts, by name.
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_MIT_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_UNLICENSE = "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_UNLICENSE_REST = "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
_GNU = "This {0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} Public License as published by the Free Software Foundation, either version {2} of the License, or (at your option) any later version."
_GNU_WARRANTY = " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} Public License for more details."


def _gnu(what: str, kind: str, version: str) -> tuple[str, ...]:
    """Short and long notices of a GNU licence."""
    title = f"the GNU {kind} Public License, version {version}."
    notice = _GNU.format(what, kind, version)
    return f"This work is licensed under {title}", f"Licensed under {title}", notice, notice + _GNU_WARRANTY.format(what, kind)


def _creative(kind: str, title: str, version: str) -> tuple[str, ...]:
    return f"Licensed under CC {kind} {version}.", f"This work is licensed under a Creative Commons {title} {version} {'International' if version == '4.0' else 'Unported'} License."


TEMPLATES = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", _MIT, f"{_MIT} {_MIT_WARRANTY}"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "Apache-1.1": ("Licensed under the Apache License, Version 1.1.", "Licensed under the Apache Software License, Version 1.1."),
    "GPL-2.0": _gnu("program", "General", "2"),
    "GPL-3.0": _gnu("program", "General", "3"),
    "LGPL-2.0": _gnu("library", "Library General", "2"),
    "LGPL-2.1": _gnu("library", "Lesser General", "2.1"),
    "LGPL-3.0": _gnu("library", "Lesser General", "3"),
    "AGPL-3.0": _gnu("program", "Affero General", "3"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", _BSD_2, f"{_BSD_2} {_BSD_WARRANTY}"),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", f"{_BSD_2} {_BSD_3}", f"{_BSD_2} {_BSD_3} {_BSD_WARRANTY}"),
    "ISC": ("Licensed under the ISC License.", _ISC, f"{_ISC} {_ISC_WARRANTY}"),
    "MPL-1.1": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/1.1/.",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",),
    "EPL-1.0": (
        "Licensed under the Eclipse Public License, version 1.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    ),
    "EPL-2.0": (
        "Licensed under the Eclipse Public License, version 2.0.",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", _UNLICENSE, f"This is free and unencumbered software released into the public domain. {_UNLICENSE} {_UNLICENSE_REST} {_MIT_WARRANTY}"),
    "CC0-1.0": (
        "Licensed under CC0 1.0.",
        "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
    ),
    **{f"CC-{kind}-{version}": _creative(kind, title, version) for kind, title in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives")) for version in ("3.0", "4.0")},
}
LEAST = 0.8
NEAR = 0.5  # templates of different licences are neighbours from this measure on
DENIED = r"\b(?:not|never|no longer) (?:[a-z0-9]+ ){0,2}(?:licensed|released|available)\b"  # in normalised text


def words_of(text: Column) -> Column:
    """Normalised words."""
    clean = F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def bigrams_of(words: Column) -> Column:
    """Distinct word bigrams."""
    n = F.size(words)
    pairs = F.zip_with(F.slice(words, 1, F.greatest(n - 1, F.lit(0))), F.slice(words, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(pairs)


def _plain_bigrams(text: str) -> set[tuple[str, str]]:
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return set(zip(words, words[1:]))


def anchor_words(least: float) -> list[str]:
    """Words of which every matching unit holds one.

    A unit that reaches `least` has at least least / (2 - least) of the template's b bigrams,
    m say.  So if more than b - m of them hold an anchor word, the unit holds one, too.
    Words are chosen greedily, by how many bigrams they add to templates that need them, long words first.
    """
    grams = [_plain_bigrams(t) for texts in TEMPLATES.values() for t in texts]
    chosen: list[str] = []
    while True:
        gain: dict[str, int] = {}
        for g in grams:
            need = len(g) - math.ceil(len(g) * least / (2 - least) - 1e-9) + 1
            open_ = [x for x in g if not set(x) & set(chosen)]
            short = need - (len(g) - len(open_))
            for w in {w for x in open_ for w in x} if short > 0 else ():
                gain[w] = gain.get(w, 0) + min(short, sum(w in x for x in open_))
        if not gain:
            return sorted(chosen)
        chosen.append(max(gain, key=lambda w: (min(len(w), 7), gain[w], w)))


def may_match(text: Column, least: float) -> Column:
    """The lower-cased text holds an anchor word: a substring test for long words, whole words for short ones."""
    low, words = F.lower(text), anchor_words(least)
    out = F.lit(False)
    for w in words:
        if len(w) >= 7:
            out = out | low.contains(w)
    few = [w for w in words if len(w) < 7]
    return out | low.rlike(f"(?<![a-z0-9])(?:{'|'.join(few)})(?![a-z0-9])") if few else out


def template_rules(spark: SparkSession) -> DataFrame:
    """(template, marks, holders): the bigrams that each neighbour lacks, and the templates of other licences that hold nine tenths of it and are a tenth larger."""
    grams = [(f"{name}#{i}", name, _plain_bigrams(t)) for name, texts in TEMPLATES.items() for i, t in enumerate(texts)]
    rows = []
    for template, name, own in grams:
        others = [(t, g) for t, other, g in grams if other != name]
        lacks = sorted({tuple(sorted(" ".join(b) for b in own - g)) for _, g in others if own - g and 2 * len(own & g) >= NEAR * (len(own) + len(g))})
        holders = [t for t, g in others if 10 * len(own & g) >= 9 * len(own) and 10 * len(g) >= 11 * len(own)]
        array = lambda x, kind: F.lit(x).cast(kind) if x else F.array().cast(kind)
        rows.append(F.struct(F.lit(template).alias("template"), array([list(x) for x in lacks], "array<array<string>>").alias("marks"), array(holders, "array<string>").alias("holders")))
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def template_bigrams(spark: SparkSession) -> DataFrame:
    """(template, name, size, bigram)"""
    rows = [(f"{name}#{i}", name, text) for name, texts in TEMPLATES.items() for i, text in enumerate(texts)]
    listed = F.explode(F.array(*(F.struct(F.lit(t).alias("template"), F.lit(n).alias("name"), F.lit(x).alias("text")) for t, n, x in rows))).alias("t")
    made = spark.range(1).select(listed).select("t.*").withColumn("b", bigrams_of(words_of(F.col("text"))))
    return made.select("template", "name", F.size("b").alias("size"), F.explode("b").alias("bigram"))


def units_of(text: Column) -> Column:
    """Lines, sentences, runs of lines, two and three runs in a row, and the whole text."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    sentences = F.split(F.regexp_replace(text, "([.!?])[ \t]+", "$1\n"), "\n")
    runs = F.split(text, "\n[ \t\n]*\n")
    n = F.size(runs)

    def after(i: int) -> Column:
        return F.slice(runs, i + 1, F.greatest(n - i, F.lit(0)))

    two = F.zip_with(F.slice(runs, 1, F.greatest(n - 1, F.lit(0))), after(1), lambda a, b: F.concat(a, F.lit("\n"), b))
    three = F.zip_with(F.slice(two, 1, F.greatest(n - 2, F.lit(0))), after(2), lambda a, b: F.concat(a, F.lit("\n"), b))
    return F.array_distinct(F.concat(F.split(text, "\n"), sentences, runs, two, three, F.array(text)))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row per doc_id: licences (sorted names), n_units (units that match), best (largest Dice)."""
    docs = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    templates = template_bigrams(docs.sparkSession)
    units = docs.where(may_match(F.col("text"), least)).select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(units_of(F.col("text"))).alias("unit", "line"))
    ratio = least / (2 - least)
    sizes = [len(_plain_bigrams(t)) for texts in TEMPLATES.values() for t in texts]
    low, high = int(min(sizes) * ratio), int(max(sizes) / ratio) + 1  # the bounds of all templates, before bigrams are exploded
    units = units.where(may_match(F.col("line"), least))
    units = units.withColumn("words", words_of(F.col("line"))).where(F.size("words") > low)
    units = units.where(~F.array_join("words", " ").rlike(DENIED)).withColumn("b", bigrams_of(F.col("words"))).withColumn("size", F.size("b")).where(F.col("size").between(low, high))
    each = units.select("doc_id", "text_key", "unit", F.col("size").alias("own"), F.explode("b").alias("bigram"))
    met = each.join(F.broadcast(templates), "bigram").where((F.col("own") >= ratio * F.col("size") - 1e-6) & (F.col("own") <= F.col("size") / ratio + 1e-6))
    # rows of equal id and text meet here: each common bigram stands once for each of them
    common = met.groupBy("doc_id", "text_key", "unit", "template", "name", "own", "size").agg(F.collect_set("bigram").alias("held"), F.count("*").alias("all")).withColumn("n", F.size("held"))
    dice = common.withColumn("dice", 2 * F.col("n") / (F.col("own") + F.col("size"))).where(F.col("dice") >= least)
    dice = dice.join(F.broadcast(template_rules(docs.sparkSession)), "template").where(F.forall("marks", lambda m: 2 * F.size(F.array_intersect("held", m)) > F.size(m)))
    of_text = Window.partitionBy("doc_id", "text_key")
    dice = dice.withColumn("all_of", F.collect_set("template").over(of_text)).where(~F.arrays_overlap("all_of", "holders"))
    near = F.sort_array(F.collect_set(F.struct("dice", "name")), asc=False)
    matched = dice.groupBy("doc_id", "text_key", "unit").agg(near.alias("near"), F.max(F.col("all") / F.col("n")).cast("long").alias("rows"))
    matched = matched.withColumn("best", F.col("near")[0]["dice"])
    matched = matched.withColumn("names", F.transform(F.filter("near", lambda x: x["dice"] == F.col("best")), lambda x: x["name"]))
    found = matched.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("licences"), F.sum("rows").alias("n_units"), F.max("best").alias("best"))
    ids = docs.select("doc_id").distinct()
    out = ids.alias("i").join(found.alias("f"), F.col("i.doc_id").eqNullSafe(F.col("f.doc_id")), "left")
    return out.select("i.doc_id", F.coalesce(F.concat_ws(",", "licences"), F.lit("")).alias("licences"), F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), F.coalesce("best", F.lit(0.0)).alias("best"))
