"""License scans: TF-IDF cosine of headers and files to license templates, and inheritance along directories.

DataFrame functions only.  Every line, paragraph and whole text of every file is
held against all templates; a file without a license of its own takes that of the nearest
directory above it that has a license file.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._scratch import materialise

LEAST_COSINE = 0.8
#: What a license was found in.
KINDS = ("line", "paragraph", "file")
#: A file whose license lines make up such a share of its words is a license file, whatever its name.
FILE_SHARE = 0.5
FILE_NAME = r"(?i)^(licen[sc]e|copying|unlicense|notice)([.-].*)?$"

#: Parts paragraphs.
PARAGRAPH = r"\n[\x20\x09-\x0D]*\n"

#: Statements by which files and license files name their license.
TEMPLATES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Released under the Simplified BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the Modified BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "Released into the public domain under CC0 1.0 Universal."),
    ("EPL-2.0", "Licensed under the Eclipse Public License, Version 2.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("ISC", "Released under the ISC License."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "Released into the public domain under the Unlicense."),
]


#: Identifiers that files name a license by.
SPDX = """
0BSD AFL-3.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-3.0 CC-BY-4.0
CC-BY-NC-4.0 CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later
GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.0 LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later LPPL-1.3c MIT MIT-0 MPL-1.1 MPL-2.0
MS-PL NCSA ODbL-1.0 OFL-1.1 OSL-3.0 PostgreSQL PSF-2.0 Python-2.0 Unlicense UPL-1.0 Vim W3C WTFPL Zlib ZPL-2.1
""".split()

_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"""
_BSD_2 = """1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without
specific prior written permission."""
_BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR
BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY
OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software
Foundation, either version {version} of the License, or (at your option) any later version."""
_GNU_AS_IS = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU {name} General Public License for more details."""
_FAMILIES = [
    ("GPL", "", (("2", "June 1991"), ("3", "29 June 2007"))), ("LGPL", "Lesser", (("2.1", "February 1999"), ("3", "29 June 2007"))), ("AGPL", "Affero", (("3", "19 November 2007"),)),
]


def _gnu() -> list[tuple[str, str]]:
    out = []
    for family, name, versions in _FAMILIES:
        for version, day in versions:
            label = f"{family}-{version if '.' in version else version + '.0'}"
            notice = _GNU.format(name=name, version=version)
            out += [
                (f"{label}-or-later", notice),
                (f"{label}-or-later", notice + " " + _GNU_AS_IS.format(name=name)),
                (f"{label}-only", notice.replace("either version", "version").replace(", or (at your option) any later version.", ".")),
                (label, f"GNU {name} GENERAL PUBLIC LICENSE Version {version}"),
                (label, f"GNU {name} GENERAL PUBLIC LICENSE Version {version}, {day}"),
                (label, f"Licensed under the GNU {name} General Public License, version {version}."),
                (label, f"Released under the terms of the GNU {name} General Public License version {version}."),
            ]
        out.append((family, f"GNU {name} GENERAL PUBLIC LICENSE"))
    return out


#: Identifiers, titles, standard headers, and texts of license files: paragraph by paragraph and, for short licenses, whole.
TEMPLATES += [
    *((x, f"SPDX-License-Identifier: {x}") for x in SPDX if f"SPDX-License-Identifier: {x}" not in {t for _, t in TEMPLATES}),
    *_gnu(),
    ("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("MIT", _MIT), ("MIT", _MIT_NOTICE), ("MIT", "\n\n".join([_MIT, _MIT_NOTICE, _AS_IS])),
    ("ISC", "ISC License"), ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies."), ("ISC", _ISC_AS_IS),
    ("ISC", _ISC + ", provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_AS_IS),
    ("0BSD", _ISC + "."), ("0BSD", _ISC + ".\n\n" + _ISC_AS_IS),
    ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-2-Clause", "\n\n".join([_BSD, _BSD_2, _BSD_AS_IS])),
    ("BSD-3-Clause", "BSD 3-Clause License"), ("BSD-3-Clause", _BSD_3), ("BSD-3-Clause", "\n\n".join([_BSD, _BSD_2, _BSD_3, _BSD_AS_IS])),
    ("Apache-2.0", "Apache License"), ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", "TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"""),
    ("Apache-2.0", """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS
OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0"),
    ("BSL-1.0", "Boost Software License - Version 1.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."""),
    ("Zlib", """Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", """Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]

#: A template of more distinct terms than this is found by how many of them a unit has.
SHORT = 12
#: Upper bounds of a term's weight in any template are rounded up to multiples of this.
STEP = 0.05


def words_of(text: str) -> list[str]:
    """A text's terms; ``+`` after a version means that version or later."""
    return re.findall(r"[a-z0-9]+", re.sub(r"([0-9])\+", r"\1 or later", text.lower()))


def versions(templates: list[tuple[str, str]] = TEMPLATES) -> list[tuple[str, str, int]]:
    """``template, term, times``: the numbers of short templates, which are versions for the most part."""
    out = []
    for i, (name, text) in enumerate(templates):
        terms = words_of(text)
        if len(set(terms)) <= SHORT:
            out += [(f"{i:03d}|{name}", t, terms.count(t)) for t in sorted(set(terms)) if t.isdigit()]
    return out


def model(templates: list[tuple[str, str]] = TEMPLATES) -> tuple[dict[str, float], list[tuple[str, str, float]], float]:
    """Inverse document frequencies; unit weights ``template, term, weight``; the frequency of unknown terms.

    A term's weight in a text is its count times its inverse document frequency.
    """
    terms = [words_of(text) for _, text in templates]
    df = Counter(t for x in terms for t in set(x))
    n = len(templates)
    idf = {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()}
    weights = []
    for i, ((name, _), words) in enumerate(zip(templates, terms, strict=True)):
        raw = {t: k * idf[t] for t, k in Counter(words).items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        weights += [(f"{i:03d}|{name}", t, v / norm) for t, v in sorted(raw.items())]
    return idf, weights, math.log(1 + n) + 1


def _by_level(term: Column, levels: dict[float, list[str]]) -> Column:
    """The level whose terms hold ``term``, the commonest levels asked first; null for others."""
    out = None
    for level, terms in sorted(levels.items(), key=lambda x: -len(x[1])):
        out = F.when(term.isin(terms), F.lit(level)) if out is None else out.when(term.isin(terms), F.lit(level))
    return out


def candidate_units(text: Column, idf: dict[str, float], weights: list[tuple[str, str, float]], unknown: float, least_cosine: float) -> Column:
    """``kind, line, size, norm, known`` of the units of a text that leave room for the cosine: the others cannot reach it.

    Units are the lines (kind 0), the paragraphs of several lines (1), and the
    whole text if it has several paragraphs (2); ``known`` holds their ``term, tf,
    v`` that templates have, and ``norm`` is that of all their terms.

    A cosine is at most the norm of the template's weights on the unit's own
    terms, so that a unit has one of the template's heaviest terms, whose rest
    would fall short, and for a template of many terms so many as make up that
    norm.  Of the units left, terms are counted within the row, as runs of their
    sorted words.  Then a cosine is at most the share that known terms have of the
    unit's norm, and at most what it would be if each term had the largest weight
    that it has in any template: long texts, whose counts are mostly those of
    common words, fall short of that.

    Each step hands its result to the next one's lambda, so that nothing is
    worked out twice.
    """
    least = least_cosine**2 * (1 - 1e-9)
    templates: dict[str, list[tuple[float, str]]] = {}
    heaviest: dict[str, float] = {}
    for template, term, w in weights:
        templates.setdefault(template, []).append((w * w, term))
        heaviest[term] = max(heaviest.get(term, 0.0), w)
    cues: set[str] = set()
    fewest = {True: 10**9, False: 10**9}
    for terms in templates.values():
        terms.sort(reverse=True)
        covered = [sum(w for w, _ in terms[:k]) for k in range(len(terms) + 1)]
        short = len(terms) <= SHORT
        fewest[short] = min(fewest[short], next(k for k, c in enumerate(covered) if c >= least))
        if short:
            cues |= {t for _, t in terms[: next(k for k, c in enumerate(covered) if covered[-1] - c < least)]}
    rarities: dict[float, list[str]] = {}
    bounds: dict[float, list[str]] = {}
    for t, f in sorted(idf.items()):
        rarities.setdefault(f, []).append(t)
        bounds.setdefault(math.ceil(heaviest[t] / STEP) * STEP, []).append(t)
    name = lambda x, **more: F.struct(x["kind"].alias("kind"), x["line"].alias("line"), *(c.alias(k) for k, c in more.items()))

    def units(kind: int, parts: Column) -> Column:
        spelled = lambda t: F.regexp_replace(F.lower(t), r"([0-9])\+", "$1 or later")
        return F.transform(parts, lambda t, i: F.struct(F.lit(kind).alias("kind"), i.alias("line"), F.array_remove(F.split(spelled(t), "[^a-z0-9]+"), "").alias("words")))

    paragraphs = F.split(text, PARAGRAPH)
    several = F.when(F.size(paragraphs) > 1, F.array(text)).otherwise(F.array().cast("array<string>"))
    split = F.concat(units(0, F.split(text, "\n")), units(1, F.filter(paragraphs, lambda p: F.contains(p, F.lit("\n")))), units(2, several))
    known = F.transform(split, lambda x: name(x, words=x["words"], d=F.array_distinct(F.filter(x["words"], lambda w: w.isin(sorted(idf))))))

    def enough(x: Column) -> Column:
        k = F.size(x["d"])
        return (k >= fewest[False]) | ((k >= fewest[True]) & F.exists(x["d"], lambda t: t.isin(sorted(cues))))

    ordered = F.transform(F.filter(known, enough), lambda x: name(x, words=F.sort_array(x["words"])))

    def ends(x: Column) -> Column:
        last = F.size(x["words"]) - 1
        return F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | (F.get(x["words"], i) != F.get(x["words"], i + 1)))

    def runs(x: Column) -> Column:
        return F.transform(x["ends"], lambda e, i: F.struct(F.get(x["words"], e).alias("term"), (e - F.coalesce(F.get(x["ends"], i - 1), F.lit(-1))).cast("double").alias("tf")))

    def weighed(r: Column) -> Column:
        rarity = F.when(r["term"].isin(sorted(idf)), _by_level(r["term"], rarities))
        return F.struct(r["term"].alias("term"), r["tf"].alias("tf"), (r["tf"] * F.coalesce(rarity, F.lit(unknown))).alias("v"), rarity.isNotNull().alias("known"))

    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda s, r: s + f(r))
    ended = F.transform(ordered, lambda x: name(x, words=x["words"], ends=ends(x)))
    counted = F.transform(ended, lambda x: name(x, size=F.size(x["words"]), runs=F.transform(runs(x), weighed)))
    measured = F.transform(counted, lambda x: name(x, size=x["size"], square=total(x["runs"], lambda r: r["v"] * r["v"]), known=F.filter(x["runs"], lambda r: r["known"])))

    def room(x: Column) -> Column:
        share = total(x["known"], lambda r: r["v"] * r["v"]) >= least * (1 - 1e-6) * x["square"]
        return share & (total(x["known"], lambda r: r["v"] * _by_level(r["term"], bounds)) >= least_cosine * (1 - 1e-6) * F.sqrt(x["square"]))

    return F.transform(F.filter(measured, room), lambda x: name(x, size=x["size"].cast("double"), norm=F.sqrt(x["square"]), known=x["known"]))


def license_scan(files: DataFrame, least_cosine: float = LEAST_COSINE) -> DataFrame:
    """``doc_id, path, license, how, cosine`` for each row of ``files`` (``doc_id, path, text``).

    A version is never matched approximately: a unit has all numbers of a template
    of at most ``SHORT`` terms, each as often as the template does.

    ``how`` is ``line``, ``paragraph`` or ``file`` for a license found in the file itself
    (by the unit with the highest cosine; of equal ones versions come before a
    mere family, lines before paragraphs, then the first of these, then the first template), ``directory`` for an inherited one, null without any.  A directory's license is that of
    the first of its license files by path that has one; a license file is
    named like one, or has ``FILE_SHARE`` of its words in units that name a license.

    Null and empty texts have no lines of their own and may inherit.  A null path
    lies in no directory.  Rows that repeat ``doc_id`` and ``path`` have one license
    between them and stay, row by row.  Other columns are not read.  An empty
    table gives an empty table; very long texts have more units, one row at a
    time.  The templates, which are fixed, are all that is broadcast.
    """
    spark = files.sparkSession
    idf, weights, unknown = model()
    times = {(template, term): n for template, term, n in versions()}
    numbers = Counter(template for template, _ in times)
    rows = [(*w, times.get(w[:2], 0), numbers[w[0]]) for w in weights]
    weight = F.broadcast(spark.createDataFrame(rows, "template string, term string, weight double, times int, numbers int"))
    files = files.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("path").cast("string").alias("path"), "text")
    keys = ["doc_id", "path"]

    n_words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    near = files.select(*keys, n_words.alias("n_words"), F.explode(candidate_units(F.col("text"), idf, weights, unknown, least_cosine)).alias("x"))
    unit = [*keys, "kind", "line", "of"]
    lines = near.select(*keys, "n_words", "x.*", F.xxhash64("x.known").alias("of")).dropDuplicates(unit)  # rows that repeat a key
    lines = lines.select(*unit, "n_words", "size", "norm", F.explode("known").alias("r")).select("*", "r.term", "r.tf", "r.v")
    dots = lines.join(weight, "term").groupBy(*unit, "n_words", "size", "norm", "template").agg(
        F.sum(F.col("v") * F.col("weight")).alias("dot"), F.max("numbers").alias("numbers"), F.count_if((F.col("times") > 0) & (F.col("tf") >= F.col("times"))).alias("found")
    ).where("found = numbers")
    scored = dots.select(*unit, "template", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"), "size", "n_words")
    matched = materialise(scored.where(F.col("cosine") >= least_cosine), "license-lines")
    family = F.substring_index("template", "|", -1).isin(*(f for f, _, _ in _FAMILIES))  # a license's name alone, without its version
    best = F.struct((-F.col("cosine")).alias("low"), family.alias("family"), F.col("kind"), F.col("line"), F.col("template"))
    own = matched.groupBy(*keys).agg(F.min(best).alias("best"), F.max("n_words").alias("n_words"))
    sizes = matched.select(*unit, "size").distinct().groupBy(*keys, "kind").agg(F.sum("size").alias("size"))
    sizes = sizes.groupBy(*keys).agg(F.max("size").alias("license_words"))  # units of several kinds overlap

    own = own.join(sizes, [own[k].eqNullSafe(sizes[k]) for k in keys]).select(
        *(own[k].alias(f"_{k}") for k in keys), F.substring_index("best.template", "|", -1).alias("own"), F.element_at(F.array(*map(F.lit, KINDS)), F.col("best.kind") + 1).alias("kind"), (-F.col("best.low")).alias("cosine"), "license_words", "n_words"
    )
    held = files.select(*keys)
    found = held.join(own, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("path").eqNullSafe(F.col("_path")), "left").drop("_doc_id", "_path")
    found = found.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit("")))

    found = materialise(found, "license-files")
    is_file = F.element_at(F.split("path", "/"), -1).rlike(FILE_NAME) | (F.col("license_words") >= FILE_SHARE * F.col("n_words"))
    declared = found.where(F.col("own").isNotNull() & is_file & F.col("dir").isNotNull())
    declared = declared.groupBy("dir").agg(F.min(F.struct("path", "own")).alias("first")).select(F.col("dir").alias("above"), F.col("first.own").alias("inherited"))
    parts = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    dirs = found.select("dir").where("dir IS NOT NULL").distinct().select("dir", F.explode(F.array_distinct(above)).alias("above"))
    nearest = dirs.join(declared, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "inherited")).alias("near"))
    nearest = nearest.select("dir", F.col("near.inherited").alias("inherited"))
    return found.join(nearest, "dir", "left").select(
        "doc_id", "path", F.coalesce("own", "inherited").alias("license"), F.when(F.col("own").isNotNull(), F.col("kind")).when(F.col("inherited").isNotNull(), "directory").alias("how"), "cosine"
    )


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as files: by source, in folders of 4,000 and 400 ids; the first 20 of 400 ids are named as license files."""
    folder = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    name = F.when(F.floor(F.col("doc_id") / 20) % 20 == 0, "LICENSE").otherwise(F.concat("doc_id", F.lit(".txt")))
    return docs.select("doc_id", F.concat_ws("/", "source", folder(4000), folder(400), name).alias("path"), "text")


def query(spark, sf_dir: str) -> DataFrame:
    return license_scan(as_files(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _sql() -> str:
    idf, weights, unknown = model()
    values = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"CAST({x!r} AS DOUBLE)" for x in r) + ")" for r in rows)
    return rf"""
WITH weights(template, term, weight) AS (VALUES {values(weights)}),
idfs(term, idf) AS (VALUES {values(sorted(idf.items()))}),
versions(template, term, times) AS (VALUES {', '.join(f"('{t}', '{w}', {n})" for t, w, n in versions())}),
numbers AS (SELECT template, count(*) AS numbers FROM versions GROUP BY template),
files AS (SELECT doc_id, concat_ws('/', source, CAST(doc_id // 4000 AS VARCHAR), CAST(doc_id // 400 AS VARCHAR), CASE WHEN doc_id // 20 % 20 = 0 THEN 'LICENSE' ELSE doc_id || '.txt' END) AS path,
  text, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')) AS n_words FROM documents),
parts AS (SELECT doc_id, path, text, string_split(text, chr(10)) AS ls, regexp_split_to_array(text, '{PARAGRAPH}') AS ps FROM files),
units AS (SELECT doc_id, path, 0 AS kind, ls AS us FROM parts UNION ALL SELECT doc_id, path, 1, list_filter(ps, lambda p: contains(p, chr(10))) FROM parts UNION ALL SELECT doc_id, path, 2, [text] FROM parts WHERE len(ps) > 1),
lines AS (SELECT doc_id, path, kind, i - 1 AS line, list_extract(us, i) AS t FROM units, UNNEST(range(1, len(us) + 1)) AS u(i)),
terms AS (SELECT doc_id, path, kind, line, unnest(regexp_split_to_array(regexp_replace(lower(t), '([0-9])\+', '\1 or later', 'g'), '[^a-z0-9]+')) AS term FROM lines),
tfs AS (SELECT doc_id, path, kind, line, term, count(*) AS tf FROM terms WHERE term <> '' GROUP BY ALL),
counted AS (SELECT doc_id, path, kind, line, term, tf, tf * coalesce(idf, CAST({unknown!r} AS DOUBLE)) AS v FROM tfs LEFT JOIN idfs USING (term)),
norms AS (SELECT doc_id, path, kind, line, sqrt(sum(v * v)) AS norm, sum(tf) AS size FROM counted GROUP BY ALL),
dots AS (SELECT doc_id, path, kind, line, template, sum(v * weight) AS dot FROM (
  SELECT c.*, w.template, w.weight, coalesce(tf >= times, FALSE) AS has FROM counted c JOIN weights w USING (term) LEFT JOIN versions s ON s.template = w.template AND s.term = w.term)
  LEFT JOIN numbers USING (template) GROUP BY doc_id, path, kind, line, template, numbers HAVING count(*) FILTER (has) = coalesce(numbers, 0)),
matched AS (SELECT doc_id, path, kind, line, template, size, round(dot / norm, 6) AS cosine FROM dots JOIN norms USING (doc_id, path, kind, line) WHERE round(dot / norm, 6) >= {LEAST_COSINE}),
own AS (SELECT doc_id, path, string_split(template, '|')[2] AS own, ['line', 'paragraph', 'file'][kind + 1] AS kind, cosine FROM matched QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY cosine DESC, string_split(template, '|')[2] IN ({', '.join(repr(f) for f, _, _ in _FAMILIES)}), matched.kind, line, template) = 1),
sizes AS (SELECT doc_id, path, max(size) AS license_words FROM (SELECT doc_id, path, kind, sum(size) AS size FROM (SELECT DISTINCT doc_id, path, kind, line, size FROM matched) GROUP BY ALL) GROUP BY doc_id, path),
found AS (SELECT f.doc_id, f.path, own, kind, cosine, regexp_replace(f.path, '/[^/]*$', '') AS dir, f.path LIKE '%/LICENSE' OR license_words >= {FILE_SHARE} * n_words AS is_file
  FROM files f LEFT JOIN own o ON o.doc_id = f.doc_id AND o.path = f.path LEFT JOIN sizes s ON s.doc_id = f.doc_id AND s.path = f.path),
declared AS (SELECT dir, arg_min(own, path) AS inherited FROM found WHERE own IS NOT NULL AND is_file GROUP BY dir),
nearest AS (SELECT d.dir, arg_max(inherited, length(c.dir)) AS inherited FROM (SELECT DISTINCT dir FROM found) d JOIN declared c ON d.dir = c.dir OR starts_with(d.dir, c.dir || '/') GROUP BY d.dir)
SELECT doc_id, path, coalesce(own, inherited) AS license, CASE WHEN own IS NOT NULL THEN kind WHEN inherited IS NOT NULL THEN 'directory' END AS how, cosine
FROM found LEFT JOIN nearest USING (dir)
"""


SQL = _sql()
