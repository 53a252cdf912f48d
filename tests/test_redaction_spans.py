"""Spans of large dictionaries against one regular expression each and the plain rule of overlaps."""

import random
import re
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from ferrule.operators import redaction
from ferrule.operators.redaction import Dictionary


def settled(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[2])):
        if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
            kept.append(s)
    return sorted(kept)


def brute(rows, dictionary, strict=False):
    rules = [(k, re.escape(x)) for k, xs in dictionary.entities.items() for x in xs] + dictionary.rules(strict)
    out = []
    for i, text in rows:
        found = [(m.start(), m.end(), k) for k, p in rules for m in re.finditer(p, text or "") if m.end() > m.start()]
        found = [s for s in found if s[2] != "NUM" or sum(map(str.isdigit, text[s[0] : s[1]])) >= 2]
        out += [(i, n, *s, text[s[0] : s[1]]) for n, s in enumerate(settled(found))]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


@given(st.lists(st.tuples(st.integers(0, 20), st.integers(1, 8), st.sampled_from("XYZ")), max_size=25))
def test_resolved(spans):
    spans = [(a, a + n, k) for a, n, k in spans]
    assert redaction.resolved(spans) == settled(spans)


@pytest.mark.parametrize("strict", [False, True])
def test_small(spark, strict):
    rows = [(1, "aaaa Then The Thenab aab 10 mm ä🌉The"), (2, None), (3, ""), (4, "Acme Corp. of Acme, 12-34 and a@b.c")]
    d = Dictionary({"A": ("aa", "aab", "The", "Acme"), "B": ("The", "Then", "ä🌉", "Acme Corp")}, {"MAIL": (r"\w+@[\w.]+",)})
    df = spark.createDataFrame(rows, "doc_id int, text string")
    assert got(redaction.entities(df, d, strict)) == brute(rows, d, strict)


def test_passes(spark, monkeypatch):
    """A dictionary of several automata."""
    monkeypatch.setattr(redaction, "MOST_LITERALS", 3)
    rng = random.Random(5)
    rows = [(i, "".join(rng.choice("abc A1") for _ in range(60))) for i in range(40)]
    d = Dictionary({"A": ("ab", "abc", "c ", "bb", "a"), "B": ("ca", "abca", "A1", "zz")}, {"P": ("b+",)})
    df = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    for strict in (False, True):
        assert got(redaction.entities(df, d, strict)) == brute(rows, d, strict)


def test_hundred_thousand(spark, sf):
    """A hundred thousand entities over the documents, most of which no text has."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    words = sorted({w for _, t in rows for w in (t or "").split() if len(w) > 6})[:300]
    d = Dictionary({"W": tuple(words), "N": tuple(f"none of {i}" for i in range(100_000))})
    few = Dictionary({"W": tuple(words)})
    assert got(redaction.entities(docs, d)) == brute(rows, few)


def test_texts_are_searched_and_redacted_once(spark, sf, monkeypatch):
    """A round trip searches each text once and redacts it once, whatever uses spans and texts afterwards."""
    from ferrule.plans import queries_process

    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    seen = {n: spark.sparkContext.accumulator(0) for n in ("found", "redacted")}

    def counted(df, name):
        def run(batches):
            for b in batches:
                seen[name].add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    entities, redact = redaction.entities, redaction.redact
    monkeypatch.setattr(redaction, "entities", lambda docs, *a: entities(counted(docs.select("doc_id", "text"), "found"), *a))
    monkeypatch.setattr(redaction, "redact", lambda *a: counted(redact(*a), "redacted"))
    back = {r["doc_id"]: r["text"] for r in queries_process.red_round_trip(spark, sf).collect()}
    assert back == {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {n: a.value for n, a in seen.items()} == {"found": docs, "redacted": docs}


def test_redacting_a_long_text(spark):
    """A token costs its own length, not the text before it."""
    text = "xé Acme y " * 40_000 + "end"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "plain")], "doc_id long, text string")
    s = redaction.entities(docs, Dictionary({"ORG": ("Acme",)}))
    begun = time.monotonic()
    rows = {r["doc_id"]: (r["redacted_text"], r["spans_replaced"]) for r in redaction.redact(docs, s, redaction.mapping(s)).collect()}
    assert time.monotonic() - begun < 20
    assert rows == {1: (text.replace("Acme", "<ORG_1>"), 40_000), 2: (None, 0), 3: ("plain", 0)}
