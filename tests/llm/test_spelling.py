import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrule.llm import spelling


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def edits(word, letters):
    for i in range(len(word) + 1):
        for c in letters:
            yield word[:i] + c + word[i:]
        if i < len(word):
            yield word[:i] + word[i + 1 :]
            for c in letters:
                yield word[:i] + c + word[i + 1 :]


def brute(rows, typo_every=97, least_chars=5, least_count=3):
    counted = Counter()
    for i, t in rows:
        for run in map(lower, re.findall(r"[A-Za-zÀ-ÿ]+", t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if typo_every and h % typo_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counted[run] += 1
    n = {w: k for w, k in counted.items() if len(w) >= least_chars and k >= least_count}
    letters = sorted(set("".join(n)))
    near = {w: {x for x in edits(w, letters) if x in n and x != w} for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: x for w, x in best.items() if n[x] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_documents(documents, rows):
    expected = brute(rows)
    assert got(spelling.spelling_variants(documents, typo_every=97)) == expected
    assert sum(r[1] is not None for r in expected) > 50


def test_many_shards(documents, rows, monkeypatch):
    """Tries of some hundred letters, blocks of some words, texts cut into pieces."""
    monkeypatch.setattr(spelling, "SHARD_LETTERS", 5_000)
    monkeypatch.setattr(spelling, "TASK_WORDS", 1_500)
    monkeypatch.setattr(spelling, "BLOCK", 100)
    monkeypatch.setattr(spelling, "COUNT_BYTES", 1_000)
    monkeypatch.setattr(spelling, "LONG_RUN", 8)
    assert got(spelling.spelling_variants(documents, typo_every=97)) == brute(rows)


def test_awkward(awkward, empty):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    for every in (None, 3):
        assert got(spelling.spelling_variants(awkward, typo_every=every)) == brute(rows, every)
    assert got(spelling.spelling_variants(empty)) == []


def test_chains_and_ties(spark):
    words = ["colour"] * 3 + ["color"] * 6 + ["colors"] * 12 + ["Größe"] * 3 + ["Größen"] * 6 + ["größen"] * 6 + ["size×"] * 3 + ["ÉTUDE", "étude", "Étude"] + ["y" * 700] * 3 + ["y" * 699] * 7
    df = spark.createDataFrame([(1, " ".join(words)), (None, None), (2, "")], "doc_id long, text string")
    out = {r["word"]: r for r in spelling.spelling_variants(df).collect()}
    assert got(spelling.spelling_variants(df)) == brute([(1, " ".join(words))], None)
    assert out["colour"]["form"] == "color" and out["colour"]["root"] == "colors" and out["colors"]["form"] is None
    assert out["y" * 700]["form"] == "y" * 699 and out["größen"]["n"] == 12
    with pytest.raises(ValueError, match="twice"):
        spelling.spelling_variants(df, ratio=1)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=7), min_size=1, max_size=40), st.sets(st.text("abcé", min_size=1, max_size=8), min_size=1, max_size=20))
def test_trie(words, asked):
    words, asked = sorted(words), sorted(asked)
    trie = spelling.CompactTrie(*spelling.letters(pa.array(words)), np.ones(len(words), np.int64))
    q, j = trie.near(*spelling.letters(pa.array(asked)))
    pairs = [(asked[a], words[b]) for a, b in zip(q.tolist(), j.tolist(), strict=True)]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(a, x) for a in asked for x in edits(a, "abcé") if x in words and x != a}


def test_equal_hashes(monkeypatch):
    """Words of one hash are still told apart."""
    monkeypatch.setattr(spelling, "span_hashes", lambda raw, first, last: np.zeros(len(first), np.uint64))
    batch = pa.RecordBatch.from_arrays([pa.array(["1"]), pa.array(["alpha betas alpha gamma"])], names=["_id", "text"])
    (out,) = spelling._count(iter([batch]), 5, None)
    assert dict(zip(out.column("word").to_pylist(), out.column("n").to_pylist(), strict=True)) == {"alpha": 2, "betas": 1, "gamma": 1}
