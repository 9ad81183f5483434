"""Licence scans with DataFrame functions alone: TF-IDF cosine to templates, then inheritance down the paths.

Every line of a text, every run of adjacent terms as long as a short template (across line breaks, so wrapped notices and
notices with further text on their line are met), the runs that a long template's anchors put in place, and for licence files the whole
text, is compared with licence templates. Terms are
lower-cased runs of ASCII letters and digits. The document frequency of the templates' terms (a fixed
vocabulary) is counted over all texts; a term outside the vocabulary has the weight of a term in no text. A line
or run is scored only if it has an anchor: the terms of a template without its anchors are too light, under the actual
weights, for a cosine of MATCH with it, so nothing is lost. The best template at
MATCH or more is the text's own licence; ties go to the template's name. An SPDX line counts as a match of 1 with
the licence it names, and WEAK is taken only if no other licence is found.

A file without a licence of its own takes that of the nearest directory above it that has a licence file; of
several in one directory, the best score counts, then the name. The root of relative and of absolute paths is "". Paths are split into their ancestor directories
(as many as the path is deep) and joined by equality, per directory and not per file.

Defined results: a null or empty text has no own licence; a null path inherits nothing; repeated rows are
answered alike; columns other than the named ones are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from raggedlake.plans.session import materialize, table

#: Notices as they stand in headers and licence files (fixed values), several a licence. A short form with a version isn't
#: there: the same words with another version would be as near to it. SPDX lines name those exactly.
TEMPLATES = {
    "AGPL-3.0": ("This program is licensed under the GNU Affero General Public License, version 3.",),
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.",),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause License.",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC0-1.0": ("Released under CC0 1.0 Universal, dedicated to the public domain.",),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.",),
    "ISC": ("Permission to use, copy, modify, and distribute this software for any purpose is hereby granted. ISC License.", "ISC License."),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "MIT": ("Released under the MIT License.", "MIT License.", "The MIT License (MIT)."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Proprietary": ("Copyright. All rights reserved. Unauthorized copying is prohibited.", "All rights reserved."),
}
#: The usual texts and headers (fixed values): compared with whole licence files, and with the one run of terms that each anchor
#: found in a text puts in place.
TEXTS = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
    obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
    distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the
    License for the specific language governing permissions and limitations under the License.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are
    met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2.
    Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
    and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to
    endorse or promote products derived from this software without specific prior written permission.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
    Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will
    be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
    Public License for more details.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
    Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will
    be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General
    Public License for more details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
    copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD
    TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
    INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
    OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
    to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or
    sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright
    notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
    WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
    NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF
    CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
}
#: A notice of more terms than this is compared with one run an anchor only.
SHORT = 30
#: Its short form also stands beside other licences ("Copyright ... All rights reserved." above a BSD notice): any other
#: licence found in the text goes before it.
WEAK = "Proprietary"
SPDX = r"(?i)SPDX-License-Identifier:[\s(]*([a-z0-9.+\-]+)"
TERM = r"[a-z0-9]+"
MATCH = 0.8
LICENSE_FILE = r"(?i)^(licen[sc]e|copying|notice|unlicense)([.\-_].*)?$"


def terms(text: str) -> list[str]:
    return re.findall(TERM, text.lower())


def _notices() -> list[tuple[str, str]]:
    return [(name, x) for name, forms in TEMPLATES.items() for x in forms] + list(TEXTS.items())


def _vocabulary() -> list[str]:
    return sorted({t for _, x in _notices() for t in terms(x)})


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def idf(docs: DataFrame, text_col: str) -> tuple[dict[str, float], float]:
    """Weights of the vocabulary's terms over all texts, and that of any other term; a row a term comes back."""
    vocab = _vocabulary()
    present = F.array_intersect(F.split(F.lower(F.col(text_col)), "[^a-z0-9]+"), F.array(*map(F.lit, vocab)))
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), F.coalesce(present, F.array()))).alias("t")).groupBy("t").count().collect()
    seen = {r["t"]: r["count"] for r in rows}  # bounded by the vocabulary; "" counts the texts
    n = seen.get("", 0)
    weigh = lambda c: math.log((n + 1) / (c + 1)) + 1
    return {t: weigh(seen.get(t, 0)) for t in vocab}, weigh(0)


def cosines(words: Column, weights: dict[str, float], other: float, match: float = MATCH) -> Column:
    """array<struct<score, license>> of a bag of terms' cosines with the templates of which it has an anchor."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    known = F.array(*map(F.lit, weights))
    weigh = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    notices = []
    for name, text in _notices():
        unit = vector(text, weights)
        held = F.array(*map(F.lit, anchors(unit, weights, match)))
        notices.append(F.struct(F.lit(name).alias("license"), F.create_map(*[F.lit(x) for pair in unit.items() for x in pair]).alias("unit"), held.alias("held")))
    # the other terms are sorted, and their runs counted in one pass: a licence file can be a long text
    strange = F.sort_array(F.filter(words, lambda w: ~F.array_contains(known, w)))
    begin = F.struct(F.lit("").alias("t"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))
    more = lambda a, w: F.when(w == a["t"], F.struct(w.alias("t"), (a["n"] + 1).alias("n"), a["sum"].alias("sum"))).otherwise(F.struct(w.alias("t"), F.lit(1.0).alias("n"), (a["sum"] + a["n"] * a["n"]).alias("sum")))
    rest = F.aggregate(strange, begin, more, lambda a: (a["sum"] + a["n"] * a["n"]) * (other * other))

    def weighed(mine: Column) -> Column:
        return F.transform(F.array_distinct(mine), lambda t: F.struct(t.alias("t"), (F.size(F.filter(mine, lambda w: w == t)) * F.element_at(weigh, t)).alias("x")))

    def scores(bag: Column) -> Column:
        dot = lambda notice: total(F.transform(bag, lambda p: p["x"] * F.coalesce(F.try_element_at(notice["unit"], p["t"]), F.lit(0.0))))
        norm = F.sqrt(total(F.transform(bag, lambda p: p["x"] * p["x"])) + rest)
        near = F.filter(F.array(*notices), lambda notice: F.arrays_overlap(words, notice["held"]))
        return _let(norm, lambda size: F.transform(near, lambda notice: F.struct((dot(notice) / size).alias("score"), notice["license"].alias("license"))))

    return _let(F.filter(words, lambda w: F.array_contains(known, w)), lambda mine: _let(weighed(mine), scores))


def vector(text: str, weights: dict[str, float]) -> dict[str, float]:
    """A notice's terms with their weights, of length 1."""
    bag = terms(text)
    out = {t: bag.count(t) * weights[t] for t in dict.fromkeys(bag)}
    size = math.sqrt(sum(x * x for x in out.values()))
    return {t: x / size for t, x in out.items()}


def anchors(unit: dict[str, float], weights: dict[str, float], match: float = MATCH) -> list[str]:
    """The fewest of a notice's terms, rarest first, one of which is in every bag of terms with a cosine of match or more.

    With the terms S in common, the cosine is at most the length of the notice's vector within S.
    """
    found, rest = [], 1.0
    for t in sorted(unit, key=lambda t: (-weights[t], t)):
        if rest < match * match - 1e-6:
            break
        found.append(t)
        rest -= unit[t] ** 2
    return found


def windows(words: Column, weights: dict[str, float], other: float, match: float = MATCH) -> Column:
    """array<struct<score, license>> of each template's cosines with the runs of as many terms around its anchors; of a long
    template, with the run that begins where an anchor's first place in the template puts it."""
    notices = []
    for name, text in _notices():
        unit = vector(text, weights)
        parts = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(weights[t]).alias("w"), F.lit(x).alias("u")) for t, x in unit.items()])
        held = F.array(*map(F.lit, anchors(unit, weights, match)))
        first = F.array(*[F.lit(terms(text).index(t)) for t in anchors(unit, weights, match)])
        notices.append(F.struct(F.lit(name).alias("license"), F.lit(len(terms(text))).alias("n"), parts.alias("parts"), held.alias("held"), first.alias("first")))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    weigh = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])
    square = lambda x: x * x

    def score(run: Column, notice: Column) -> Column:
        norm = total(F.transform(F.array_distinct(run), lambda t: square(F.size(F.filter(run, lambda w: w == t)) * F.coalesce(F.element_at(weigh, t), F.lit(other)))))
        common = F.transform(notice["parts"], lambda p: F.size(F.filter(run, lambda w: w == p["t"])) * p["w"])

        def compared(c: Column) -> Column:
            dot = total(F.zip_with(c, notice["parts"], lambda x, p: x * p["u"]))
            # the terms in common alone bound the cosine
            return F.when(dot >= (match - 1e-6) * F.sqrt(total(F.transform(c, square))), dot / F.sqrt(norm)).otherwise(0.0)

        return _let(common, compared)

    def around(w: Column, i: Column, notice: Column) -> Column:
        first = F.greatest(F.lit(0), i - notice["n"] + 1)
        last = F.greatest(first, F.least(i, F.size(w) - notice["n"]))
        place = F.greatest(F.lit(0), i - F.get(notice["first"], F.array_position(notice["held"], F.get(w, i)).cast("int") - 1))
        starts = F.when(notice["n"] > SHORT, F.array(place)).otherwise(F.sequence(first, last))
        return F.transform(starts, lambda k: F.slice(w, k + 1, notice["n"]))

    def one(w: Column, notice: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.array_contains(notice["held"], F.get(w, i)))
        runs = F.array_distinct(F.flatten(F.transform(at, lambda i: around(w, i, notice))))
        return F.struct(F.coalesce(F.array_max(F.transform(runs, lambda r: score(r, notice))), F.lit(0.0)).alias("score"), notice["license"].alias("license"))

    near = lambda w: F.filter(F.array(*notices), lambda notice: F.arrays_overlap(w, notice["held"]))
    return F.transform(near(words), lambda notice: one(words, notice))


def spdx(text: Column) -> Column:
    """array<struct<score, license>> of the identifiers named in SPDX lines: exact, not by cosine."""
    ids = F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), lambda x: F.regexp_replace(F.lower(x), r"(-only|-or-later|\+)$", ""))
    names = F.array(*[F.struct(F.lit(1.0).alias("score"), F.lit(n).alias("license")) for n in TEMPLATES if n != WEAK])
    named = _let(ids, lambda found: F.filter(names, lambda x: F.array_contains(found, F.lower(x["license"]))))
    return F.when(F.contains(F.lower(text), F.lit("spdx-license-identifier:")), named).otherwise(F.array())


def own_licenses(files: DataFrame, id_col: str, text_col: str, whole: Column, match: float = MATCH) -> DataFrame:
    """(id columns as given, text dropped) with own_license and own_score; whole: whether a row's whole text is a unit too."""
    weights, other = idf(files, text_col)
    held = F.array(*map(F.lit, sorted({t for _, x in _notices() for t in anchors(vector(x, weights), weights, match)})))
    lines = F.filter(F.split(F.col(text_col), "\n"), lambda x: F.arrays_overlap(F.split(F.lower(x), "[^a-z0-9]+"), held))
    keep = [c for c in files.columns if c != text_col]
    files = files.withColumns({"_lines": lines, "_whole": whole})
    # a whole text without an anchor in any line matches nothing
    units = F.when(F.col("_whole") & (F.size("_lines") > 0), F.concat("_lines", F.array(F.col(text_col)))).otherwise(F.col("_lines"))
    rows = files.select(*keep, F.coalesce(F.array_distinct(units), F.array()).alias("_u"), F.coalesce(spdx(F.col(text_col)), F.array()).alias("_x"), F.coalesce(_terms(F.col(text_col)), F.array()).alias("_w"))

    def better(a: Column, x: Column) -> Column:
        s = F.round(x["score"], 9)
        s = s + F.when((s >= match) & (x["license"] != WEAK), 1.0).otherwise(0.0)
        return F.when((s > a["s"]) | ((s == a["s"]) & (x["license"] < a["l"])), F.struct(s.alias("s"), x["license"].alias("l"))).otherwise(a)

    none = F.struct(F.lit(0.0).alias("s"), F.lit("").alias("l"))
    found = F.flatten(F.transform("_u", lambda u: _let(_terms(u), lambda w: cosines(w, weights, other, match))))
    runs = F.when(F.arrays_overlap("_w", held), _let(F.col("_w"), lambda w: windows(w, weights, other, match))).otherwise(F.array())
    best = F.reduce(F.concat(found, F.col("_x"), runs), none, better)
    scored = rows.withColumn("_b", best).withColumn("_b", F.struct((F.col("_b.s") - F.when(F.col("_b.s") > 1.000001, 1.0).otherwise(0.0)).alias("s"), F.col("_b.l").alias("l")))
    return scored.select(*keep, F.when(F.col("_b.s") >= match, F.col("_b.l")).alias("own_license"), F.when(F.col("_b.s") >= match, F.round("_b.s", 6)).alias("own_score"))


def ancestors(path: Column) -> Column:
    """The directories above a path, the root ("") first, nearest last; a directory counts as above its own files."""
    parts = F.split(path, "/")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/")))


def inherit(found: DataFrame, path_col: str = "path", is_license_file: Column | None = None) -> DataFrame:
    """Adds license, license_from ('own', 'inherited' or null) and license_dir to rows with own_license and a path."""
    marks = F.regexp_extract(F.col(path_col), r"([^/]*)$", 1).rlike(LICENSE_FILE) if is_license_file is None else is_license_file
    parent = F.regexp_replace(F.col(path_col), r"/?[^/]*$", "")
    rows = found.withColumns({"_dir": parent, "_is": F.coalesce(marks, F.lit(False))})
    best = F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("l")))
    holders = rows.where(F.col("_is") & F.col("own_license").isNotNull() & F.col("_dir").isNotNull()).groupBy(F.col("_dir").alias("_at")).agg(best.alias("_best")).select("_at", F.col("_best.l").alias("_l"))
    # one row for each directory that has files, not for each file
    dirs = rows.where(F.col("_dir").isNotNull()).select("_dir").distinct()
    ups = dirs.select("_dir", F.explode(ancestors(F.concat(F.col("_dir"), F.lit("/")))).alias("_at"))
    nearest = ups.join(holders, "_at").groupBy("_dir").agg(F.max(F.struct(F.length("_at").alias("n"), F.col("_at").alias("at"), F.col("_l").alias("l"))).alias("_near"))
    out = rows.join(nearest, "_dir", "left")
    got = F.coalesce("own_license", "_near.l")
    source = F.when(F.col("own_license").isNotNull(), "own").when(F.col("_near.l").isNotNull(), "inherited")
    return out.select(*found.columns, got.alias("license"), source.alias("license_from"), F.when(source == "inherited", F.col("_near.at")).alias("license_dir"))


def license_scan(files: DataFrame, id_col: str, path_col: str, text_col: str = "text", match: float = MATCH, is_license_file: Column | None = None) -> DataFrame:
    """One row a file: id, path, own_license, own_score, license, license_from, license_dir."""
    marks = F.regexp_extract(F.col(path_col), r"([^/]*)$", 1).rlike(LICENSE_FILE) if is_license_file is None else is_license_file
    rows = files.select(F.col(id_col), F.col(path_col).alias("path"), F.coalesce(marks, F.lit(False)).alias("_mark"), F.col(text_col))
    found = materialize(own_licenses(rows, id_col, text_col, F.col("_mark"), match), "licenses")
    return inherit(found, "path", F.col("_mark")).drop("_mark")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents have no paths: they are laid out as source/language/thousand/hundred/id. Ids divisible by ten are
    licence files of their thousand, ids with a five at the end those of their hundred; id 0 is one at the root."""
    d = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    level = F.floor(i / 100).cast("string")
    deep = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(i / 1000).cast("string"))
    name = F.concat(F.lit("/LICENSE."), i.cast("string"))
    path = F.when(i == 0, "LICENSE").when(i % 10 == 0, F.concat(deep, name)).when(i % 10 == 5, F.concat(deep, F.lit("/"), level, name)).otherwise(F.concat(deep, F.lit("/"), level, F.lit("/"), i.cast("string")))
    return license_scan(d.select("doc_id", "text", path.alias("path")), "doc_id", "path")
