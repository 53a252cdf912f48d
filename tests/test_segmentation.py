"""Cuts of text without blanks against all cuts, known sentences, and BM25 over Han words."""

import math
from itertools import combinations

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st

from ferrule.functions import segmentation as s
from ferrule.functions.text import words
from ferrule.operators import bm25
from pyspark.sql import functions as F

DICTIONARY = [
    ("合同", 900), ("图纸", 700), ("条款", 800), ("工程", 1000), ("工程师", 300), ("承包", 400), ("承包商", 500), ("商", 90), ("变更", 600), ("通知", 500), ("北京", 3000), ("北京大学", 800),
    ("大学", 2000), ("大学生", 900), ("学生", 2500), ("生", 400), ("前来", 300), ("应聘", 200), ("研究", 1500), ("研究生", 700), ("生命", 900), ("起源", 400), ("的", 30000), ("命", 200),
]
SENTENCES = {
    "承包商通知工程师": ["承包商", "通知", "工程师"],
    "北京大学生前来应聘": ["北京", "大学生", "前来", "应聘"],
    "研究生命的起源": ["研究", "生命", "的", "起源"],
    "合同甲乙条款": ["合同", "甲", "乙", "条款"],
    "工程图纸变更": ["工程", "图纸", "变更"],
}


def weights(dictionary):
    total = sum(n for _, n in dictionary)
    return {w: math.log(n) - math.log(total) for w, n in dictionary}, -math.log(total)


def brute(run, known, alone):
    """The best of all cuts."""
    best = None
    for k in range(len(run)):
        for at in combinations(range(1, len(run)), k):
            parts = [run[a:b] for a, b in zip((0, *at), (*at, len(run)), strict=True)]
            if all(len(p) == 1 or p in known for p in parts):
                score = sum(max(known.get(p, alone), alone) if len(p) == 1 else known[p] for p in parts)
                if best is None or score > best[0] + 1e-9:
                    best = (score, parts)
    return best


@given(st.text("abc", min_size=1, max_size=9), st.dictionaries(st.text("abc", min_size=1, max_size=4), st.integers(1, 50), max_size=12))
def test_cut_is_the_best_of_all(run, dictionary):
    known, alone = weights(sorted(dictionary.items())) if dictionary else ({}, 0.0)
    at = lambda i: [(k, known[run[i : i + k]]) for k in range(1, 5) if i + k <= len(run) and run[i : i + k] in known]
    parts = s.cut(run, at, alone)
    assert "".join(parts) == run
    assert math.isclose(sum(max(known.get(p, alone), alone) if len(p) == 1 else known[p] for p in parts), brute(run, known, alone)[0], abs_tol=1e-9)


def test_equal_cuts_take_the_longer_first_word():
    known = {"ab": -1.0, "c": -1.0, "a": -1.0, "bc": -1.0}
    at = lambda i: [(k, known["abc"[i : i + k]]) for k in (1, 2) if i + k <= 3 and "abc"[i : i + k] in known]
    assert s.cut("abc", at, -9.0) == ["ab", "c"]


@pytest.fixture(scope="module")
def lexicon(spark):
    rows = [(w, n, "x") for w, n in DICTIONARY] + [(None, 5, "x"), ("", 5, "x"), ("合同", 3, "x"), ("长" * 65, 9, "x")]
    return s.lexicon(spark.createDataFrame(rows, "word string, n long, text string"))


def test_known_sentences_both_ways(spark, lexicon):
    df = spark.createDataFrame([(t,) for t in SENTENCES], "text string")
    by_broadcast = {r["text"]: r["w"] for r in df.select("text", s.tokeniser(lexicon)(F.col("text")).alias("w")).collect()}
    assert by_broadcast == SENTENCES
    assert {r["run"]: r["words"] for r in s.cuts(df, lexicon).collect()} == SENTENCES


def test_awkward_texts(spark, lexicon):
    """Null, empty, mixed, repeated and very long texts; a run keeps every character."""
    long = "承包商甲" * 20_000
    texts = [None, "", "...", "Rev 2 工程师Smith said OK", "Rev 2 工程师Smith said OK", "ヲ", long]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r["i"]: r["w"] for r in df.select("i", s.tokeniser(lexicon)(F.col("text")).alias("w")).collect()}
    assert got[0] is None and got[1] == got[2] == []
    assert got[3] == got[4] == ["rev", "2", "工程师", "smith", "said", "ok"]
    assert got[5] == ["ヲ"] and got[6] == ["承包商", "甲"] * 20_000
    assert {r["run"]: r["words"] for r in s.cuts(df, lexicon).collect()} == {"工程师": ["工程师"], "ヲ": ["ヲ"], long: ["承包商", "甲"] * 20_000}


def test_empty_tables(spark, lexicon):
    nothing = s.lexicon(spark.createDataFrame([], "word string, n long"))
    df = spark.createDataFrame([("合同 a",)], "text string")
    assert df.select(s.tokeniser(nothing)(F.col("text")).alias("w")).first()["w"] == ["合", "同", "a"]
    assert [tuple(r) for r in s.cuts(df, nothing).collect()] == [("合同", ["合", "同"])]
    assert s.cuts(df.limit(0), lexicon).count() == 0


def test_dictionary_too_large_to_broadcast(lexicon, monkeypatch):
    monkeypatch.setattr(s, "MOST_LETTERS", 10)
    with pytest.raises(ValueError, match="too many to broadcast"):
        s.tokeniser(lexicon)


def test_latin_texts_are_as_without_a_dictionary(spark, lexicon, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("text")
    assert df.where(~words(F.col("text")).eqNullSafe(s.tokeniser(lexicon)(F.col("text")))).count() == 0


def test_bm25_by_words(spark, lexicon):
    """A question of a word finds chunks with that word, not those with its characters in other words."""
    chunks = spark.createDataFrame([(0, 0, "北京大学"), (1, 1, "大学生应聘"), (2, 2, "学生 大学"), (3, 3, "合同 条款"), (4, 4, "工程")], "chunk_id long, ord long, text string")
    asked = spark.createDataFrame([("a", "大学")], "query_id string, text string")
    by_words = s.tokeniser(lexicon)
    hits = bm25.scores(bm25.build(chunks, by_words), asked, by_words)
    assert [r["chunk_id"] for r in hits.collect()] == [2]
    assert {r["chunk_id"] for r in bm25.scores(bm25.build(chunks), asked).collect()} == {0, 1, 2}


def test_query(spark, sf):
    """Every glued text of the query, cut by the dictionary counted by DuckDB; the query's other rows are none."""
    from ferrule.plans.registry import QUERIES
    import ferrule.plans.queries_text  # noqa: F401

    known, alone = weights(duckdb.sql(f"SELECT w, count(*) FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}]+')) AS w FROM '{sf}/documents.parquet') WHERE length(w) <= 64 GROUP BY w").fetchall())
    runs = {r[0] for r in duckdb.sql(f"SELECT DISTINCT unnest(regexp_extract_all(regexp_replace(lower(text), ' ', '', 'g'), '[\\p{{L}}]+')) FROM '{sf}/benchmark.parquet'").fetchall()}
    got = {r["run"]: r["words"].split(" ") for r in QUERIES["str_segments"](spark, sf).collect()}
    assert set(got) == runs and len(runs) > 50

    def score(parts):
        return sum(max(known.get(p, alone), alone) if len(p) == 1 else known[p] for p in parts)

    for run, parts in got.items():  # the best score, found from the left
        best = [0.0] + [-math.inf] * len(run)
        for j in range(1, len(run) + 1):
            best[j] = max(best[i] + max(known.get(run[i:j], alone if j - i == 1 else -math.inf), alone if j - i == 1 else -math.inf) for i in range(max(0, j - 64), j))
        assert "".join(parts) == run and math.isclose(score(parts), best[-1], abs_tol=1e-6)
