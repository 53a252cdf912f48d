"""License scans, packing, token counts, quality rules and the classifier."""

import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from ferrule.llm import license_scan, packing, quality_model, quality_rules, token_count

WORD = r"[^\x20\x09-\x0D]+"


# -- quality rules


def brute_rules(text):
    text = text or ""
    w = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    inside = {p for i, g in enumerate(grams) if n[g] > 1 for p in range(i, i + 5)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), len(w) < 10 or 100 * len(inside) > 20 * len(w)


def brute_kept(text):
    text = text or ""
    w = re.findall(WORD, text)
    whole = max(1, sum(map(len, w)))
    worst = 0.0
    for n, most in quality_rules.NGRAM_SHARES.items():
        grams = [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]
        c = Counter(grams)
        inside = {p for i, g in enumerate(grams) if c[g] > 1 for p in range(i, i + n)}
        worst = max(worst, sum(len(w[p]) for p in inside) / whole / most)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    c = Counter(lines)
    share = sum(sum(map(len, re.findall(WORD, x))) for x in lines if c[x] > 1) / whole
    b = brute_rules(text)
    return not b[5] and worst <= 1 and share <= quality_rules.LINE_SHARE and b[2] <= quality_rules.SYMBOLS_PER_WORD * b[0]


def rules(df):
    return sorted((tuple(r)[:8] for r in quality_rules.quality_rules(df).collect()), key=repr)


def test_rules(documents, rows, awkward, empty):
    assert rules(documents) == sorted(((i, *brute_rules(t), brute_kept(t)) for i, t in rows), key=repr)
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert rules(awkward) == sorted(((i, *brute_rules(t), brute_kept(t)) for i, t in rows), key=repr)
    assert rules(empty) == []


def test_rules_repeats(spark):
    texts = ["a b c d e a b c d e f", "a b c d e\na b c d e\n \n\n \nx\nx", "a " * 30, "ä ö ü ß 中 " * 3, "no repeats in this line at all my friend ok then", "\n".join(["one line"] * 9), "a\nb a\nb"]
    rows = list(enumerate(texts))
    assert rules(spark.createDataFrame(rows, "doc_id long, text string")) == sorted(((i, *brute_rules(t), brute_kept(t)) for i, t in rows), key=repr)


# -- classifier


def test_classifier(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_model.quality_scores(docs, labels).toPandas()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out["doc_id"]]).all()
    assert out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.5)).all()
    both = out.merge(labels.toPandas(), on="doc_id")
    held = both[both["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.95
    # held-out labels change nothing
    from pyspark.sql import functions as F

    turned = labels.withColumn("quality", F.when(quality_model.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality_model.quality_scores(docs, turned).toPandas()
    assert np.allclose(out.sort_values("doc_id")["score"], again.sort_values("doc_id")["score"])


def test_classifier_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (3, 1, 0), (13, 0, 0), (14, 0, 1), (None, 1, 0), (10, None, 0), (99, 1, 0), (-5, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality_model.quality_scores(awkward, labels).collect()
    assert len(out) == awkward.count() and all(0 <= r["score"] <= 1 for r in out)
    assert {r["score"] for r in quality_model.quality_scores(awkward, labels.limit(0)).collect()} == {0.5}
    assert quality_model.quality_scores(empty, labels).count() == 0
    good = quality_model.keep_good(awkward, labels)
    assert good.dtypes == awkward.dtypes and good.count() == sum(r["predicted"] for r in out)


def test_isotonic():
    model = quality_model.Model(np.zeros((3, quality_model.N_STATISTICS)))
    model.calibrate(np.array([0.0, 1.0, 2.0, 3.0]), np.array([2.0, 2.0, 2.0, 2.0]), np.array([0.0, 2.0, 0.0, 2.0]))
    assert model.at.tolist() == [0.0, 1.5, 3.0] and model.rate.tolist() == [0.0, 0.5, 1.0]


def test_cosines_approximate_the_kernel():
    model = quality_model.Model(np.zeros((3, quality_model.N_STATISTICS)))
    model.mean, model.spread = np.zeros(quality_model.N_STATISTICS), np.ones(quality_model.N_STATISTICS)
    x = np.random.default_rng(0).normal(size=(40, quality_model.N_STATISTICS))
    z = model.features(x)[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 2 / quality_model.WIDTH**2)
    assert np.abs(z @ z.T - exact).mean() < 0.06


# -- token counts


def brute_tokens(word, scores):
    """Best score, then fewest tokens, over all segmentations, by plain dynamic programming."""
    text = token_count.START + word
    unknown = min(scores.values()) - token_count.FALLBACK
    longest = max(map(len, scores))
    best = [(0.0, 0)]
    for j in range(1, len(text) + 1):
        options = [(best[j - 1][0] + unknown, -(best[j - 1][1] + len(text[j - 1].encode())))]
        options += [(best[k][0] + scores[text[k:j]], -(best[k][1] + 1)) for k in range(max(0, j - longest), j) if text[k:j] in scores]
        s, n = max(options)
        best.append((s, -n))
    return best[-1][1]


def test_tokens_small_vocabulary():
    scores = {"▁": -2.0, "▁a": -1.0, "a": -3.0, "b": -3.0, "ab": -4.0, "▁ab": -4.0, "abc": -5.0, "c": -2.5, "ä": -1.5}
    trie = token_count.Trie(scores)
    for word in ("a", "ab", "abc", "abcabc", "abd", "ä", "äöa", "中", "🌉b", "ba" * 30, "abab"):
        assert trie.count(word.encode()) == brute_tokens(word, scores), word


def test_tokens(documents, rows, awkward, empty, monkeypatch):
    scores = token_count.vocabulary()
    for df in (documents.limit(25), awkward):
        expected, known = [], {}
        for r in df.collect():
            words = re.findall(WORD, r["text"] or "")
            for w in words:
                if w not in known:
                    known[w] = brute_tokens(w, scores)
            expected.append((r["doc_id"], len(words), sum(known[w] for w in words)))
        got = [tuple(r) for r in token_count.token_counts(df).collect()]
        assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert token_count.token_counts(empty).count() == 0
    words = sorted({w for _, t in rows[:20] for w in (t or "").split()})[:200]
    monkeypatch.setattr(token_count, "MOST_NODES", 50)  # tries given up again and again
    trie = token_count.Trie(scores)
    assert all(trie.count(w.encode()) == brute_tokens(w, scores) for w in words)


def test_tokens_of_long_words(monkeypatch):
    """Words beyond ``LONGEST`` are scored by themselves, with the same counts; they go through the trie's prefixes no more."""
    scores = token_count.vocabulary()
    words = ["x" * 5000, "lorem" * 700, "中文" * 900, "x" * 999, "x" * 1000, "x" * 1001, "lorem", "loremipsum"]
    want = [brute_tokens(w, scores) for w in words]
    for longest in (token_count.LONGEST, 3, 10_000):
        monkeypatch.setattr(token_count, "LONGEST", longest)
        trie = token_count.Trie(scores)
        assert [trie.count(w.encode()) for w in words + words] == want + want


# -- packing


def brute_pack(items, capacity, most):
    """Largest first; of all bins with room and no conflict the one with least left, then the oldest."""
    bins, rows = [], []
    rest = []
    for doc, size, source, cluster in items:
        for k in range(size // capacity):
            bins.append([0, set(), Counter()])
            rows.append((doc, k, k * capacity, capacity, len(bins) - 1, 0))
        if size % capacity:
            rest.append((size % capacity, doc, size // capacity, source, cluster))
    rest.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[4], x[3] or ""))
    for size, doc, k, source, cluster in rest:
        fits = [(b[0], i) for i, b in enumerate(bins) if b[0] >= size and cluster not in b[1] and b[2][source] < most]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([capacity, set(), Counter()])
        b = bins[i]
        rows.append((doc, k, k * capacity, size, i, capacity - b[0]))
        b[0] -= size
        b[1].add(cluster)
        b[2][source] += 1
    return rows


@pytest.mark.parametrize(("most", "hot"), [(1, 0.5), (2, 0.5), (3, 0.0)])
def test_pack(most, hot):
    rng = np.random.default_rng(4)
    items = [(i, int(rng.integers(1, 250)), "hot" if rng.random() < hot else f"s{rng.integers(9)}", int(rng.integers(60))) for i in range(400)]
    assert packing.pack(items, 100, most) == brute_pack(items, 100, most)


def check_packed(df, capacity, most, **more):
    rows = packing.best_fit_packing(df, capacity, most, **more).collect()
    docs = Counter((r["doc_id"]) for r in df.collect())
    sizes = defaultdict(list)
    for r in df.collect():
        sizes[r["doc_id"]].append(len(re.findall(WORD, r["text"] or "")) + 1)
    got = defaultdict(int)
    bins = defaultdict(list)
    for r in rows:
        got[r["doc_id"]] += r["n_tokens"]
        bins[r["bin_id"]].append((r["bin_offset"], r["n_tokens"]))
    assert got == {k: sum(v) for k, v in sizes.items()} and set(got) == set(docs)
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return rows


def test_packing(documents, awkward, empty):
    rows = check_packed(documents, 512, 2)
    source = {r["doc_id"]: r["source"] for r in documents.collect()}
    per = Counter((r["bin_id"], source[r["doc_id"]]) for r in rows if r["n_tokens"] < 512)
    assert max(per.values()) <= 2
    check_packed(documents, 512, 1, shard_rows=50)
    check_packed(awkward, 64, 2)
    assert packing.best_fit_packing(empty).count() == 0


# -- license scans


def test_licenses(spark, documents, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    columns = ["doc_id", "path", "license", "how", "cosine"]
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({license_scan.SQL})").fetchall()
    assert sorted(map(tuple, license_scan.query(spark, sf).collect()), key=repr) == sorted(expected, key=repr)


FILES = [
    (1, "a/LICENSE", "Released under the MIT License."),
    (2, "a/b/code.py", "nothing here"),
    (3, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0.\nmore"),
    (4, "a/b/c/d.py", None),
    (5, "a/b/own.py", "x\nThis work is licensed under the GNU General Public License, version 3.\ny " + "z " * 50),
    (6, "ab/x.py", ""),
    (7, "top.py", "text"),
    (8, None, "Released under the MIT License."),
    (9, None, "text"),
    (10, "a/COPYING", "no license named"),
    (11, "q/notes.md", "Licensed under CC BY-NC 4.0.\nok"),
    (12, "q/r/s.md", "text"),
    (None, "a/b/none.py", "text"),
    (13, "a/dup.py", "text"),
    (13, "a/dup.py", "text"),
]


def test_inheritance(spark, empty):
    df = spark.createDataFrame([(*f, "x", 1.0) for f in FILES], "doc_id long, path string, text string, license string, cosine double")
    got = [(r["doc_id"], r["license"], r["how"]) for r in license_scan.license_scan(df).collect()]
    assert sorted(got, key=repr) == sorted([
        (1, "MIT", "line"), (2, "Apache-2.0", "directory"), (3, "Apache-2.0", "line"), (4, "Apache-2.0", "directory"), (5, "GPL-3.0", "line"), (6, None, None), (7, None, None),
        (8, "MIT", "line"), (9, None, None), (10, "MIT", "directory"), (11, "CC-BY-NC-4.0", "line"), (12, "CC-BY-NC-4.0", "directory"), (None, "Apache-2.0", "directory"),
        (13, "MIT", "directory"), (13, "MIT", "directory"),
    ], key=repr)
    assert license_scan.license_scan(license_scan.as_files(empty)).count() == 0


def test_licenses_awkward(awkward):
    out = license_scan.license_scan(license_scan.as_files(awkward)).collect()
    assert len(out) == awkward.count() and {r["doc_id"]: (r["license"], r["how"]) for r in out if r["how"] not in (None, "directory")} == {15: ("MIT", "line")}


def wrapped(text, mark, width=60):
    import textwrap

    return "\n".join(mark + x for x in textwrap.wrap(" ".join(text.split()), width))


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:"""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source
code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_3 = "Neither the name of Acme nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"""
GPL = """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either
version 2 of the License, or (at your option) any later version."""
AGPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
https://mozilla.org/MPL/2.0/."""
REAL = [
    ("MIT", "Copyright (c) 2019 Jane Roe\n\n" + wrapped(MIT, "")),
    ("MIT", "/*\n" + wrapped(MIT, " * ") + "\n */\nint main() { return 0; }\n" + "\nint f(int xyzzy) { return xyzzy; }" * 30),
    ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2001"),
    ("BSD-3-Clause", "Copyright 2020\n\n" + wrapped(BSD, "") + "\n\n" + wrapped("3. " + BSD_3.replace("Acme", "the copyright holder"), "")),
    ("Apache-2.0", wrapped(APACHE, "# ", 70) + "\n#\n#     http://www.apache.org/licenses/LICENSE-2.0\n"),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004"),
    ("GPL-2.0-or-later", wrapped(GPL, "// ")),
    ("AGPL-3.0-or-later", "<!--\n" + wrapped(AGPL, "  ") + "\n-->"),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 2.1, February 1999"),
    ("MPL-2.0", wrapped(MPL, "/* ")),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("GPL-3.0-or-later", "#!/bin/sh\n# SPDX-License-Identifier: GPL-3.0-or-later"),
    ("LGPL-2.1-only", "// SPDX-License-Identifier: LGPL-2.1-only"),
    ("ISC", "/* SPDX-License-Identifier: ISC */"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free"),
    (None, "The license of this house permits the use of the garden, and the permission is granted to any person without charge."),
    (None, "def permission(copy, software):\n    return copy + software"),
]


def test_real_headers_and_files(spark):
    """Usual headers and license texts, wrapped, commented and embedded in code."""
    df = spark.createDataFrame([(i, f"d{i}/x", t) for i, (_, t) in enumerate(REAL)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan.license_scan(df).collect()}
    assert [got[i] for i in range(len(REAL))] == [x for x, _ in REAL]


def test_bound_loses_no_line(spark):
    """No line of random template words, others and repeats that reaches the threshold is left out beforehand."""
    idf, weights, unknown = license_scan.model()
    rng = np.random.default_rng(7)
    known = sorted(idf)
    by = defaultdict(dict)
    for template, term, w in weights:
        by[template][term] = w
    lines = [license_scan.words_of(text) + ["other"] * k for _, text in license_scan.TEMPLATES for k in range(3)]
    for template in by:
        for k in range(12):
            line = list(by[template]) * int(rng.integers(1, 3)) + [f"other{j}" for j in rng.integers(9, size=k // 3)] + [known[j] for j in rng.integers(len(known), size=k % 4)]
            lines.append([str(x) for x in rng.permutation(line)])

    def cosine(line):
        v = {t: line.count(t) * idf.get(t, unknown) for t in set(line)}
        norm = sum(x * x for x in v.values()) ** 0.5
        return max(sum(w * v.get(t, 0) for t, w in ws.items()) / norm for ws in by.values())

    from pyspark.sql import functions as F

    df = spark.createDataFrame([("\n".join(" ".join(x) for x in lines),)], "text string")
    kept = {r["line"] for r in df.select(F.inline(license_scan.candidate_units(F.col("text"), idf, weights, unknown, license_scan.LEAST_COSINE))).collect() if r["kind"] == 0}
    good = {i for i, x in enumerate(lines) if cosine(x) >= license_scan.LEAST_COSINE}
    assert good <= kept and len(good) > 100


def test_versions_are_exact(spark):
    """A line that names another version than a template's is not its license."""
    lines = ["SPDX-License-Identifier: EUPL-1.1", "SPDX-License-Identifier: EUPL-1.2", "SPDX-License-Identifier: Apache-1.0", "SPDX-License-Identifier: Apache-1.1", "Licensed under CC BY 2.0.", "Licensed under CC BY 4.0.", "Licensed under the Apache License, Version 2.0."]
    df = spark.createDataFrame([(i, f"{i}/x.txt", t) for i, t in enumerate(lines)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan.license_scan(df).collect()}
    assert got == {0: None, 1: "EUPL-1.2", 2: None, 3: "Apache-1.1", 4: None, 5: "CC-BY-4.0", 6: "Apache-2.0"}


def test_terms_count_as_often_as_they_occur(spark):
    """A common word repeated outweighs a license's name; a version "+" is that version or later."""
    lines = ["the the the the the the the the mit license the the the the", "MIT License", "SPDX-License-Identifier: GPL-2.0+", "SPDX-License-Identifier: LGPL-2.1+"]
    df = spark.createDataFrame([(i, f"{i}/x.txt", t) for i, t in enumerate(lines)], "doc_id long, path string, text string")
    got = {r["doc_id"]: r["license"] for r in license_scan.license_scan(df).collect()}
    assert got == {0: None, 1: "MIT", 2: "GPL-2.0-or-later", 3: "LGPL-2.1-or-later"}


def test_units_are_counted_within_a_row(spark):
    """Counts, norms and sizes of units equal those counted in Python."""
    from collections import Counter

    from pyspark.sql import functions as F

    idf, weights, unknown = license_scan.model()
    texts = [" ".join(["the"] * 3 + ["mit", "license", "zebra"]), "Released under the MIT License.", "mit license"]
    df = spark.createDataFrame([("\n".join(texts),)], "text string")
    rows = df.select(F.inline(license_scan.candidate_units(F.col("text"), idf, weights, unknown, 0.1))).collect()
    got = {r["line"]: (r["size"], round(r["norm"], 9), {x["term"]: x["tf"] for x in r["known"]}) for r in rows if r["kind"] == 0}
    for i, text in enumerate(texts):
        c = Counter(license_scan.words_of(text))
        norm = sum((k * idf.get(t, unknown)) ** 2 for t, k in c.items()) ** 0.5
        assert got[i] == (c.total(), round(norm, 9), {t: k for t, k in c.items() if t in idf})
