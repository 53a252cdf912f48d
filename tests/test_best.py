import random

import numpy as np
import pytest

from ferrule.operators import best, bm25, vector


def test_best_keeps_what_a_sort_keeps():
    """Slices in any order of places, with many ties, dense and sparse; what is held stays k a group."""
    rng = np.random.default_rng(1)
    for kind in (np.int64, str):
        scores, places = rng.integers(-2, 3, (5, 200)) / 2, rng.permutation(200)
        dense, sparse = best.Best(5, 7), best.Best(5, 7)
        for at in range(0, 200, 17):
            part, where = scores[:, at : at + 17], places[at : at + 17].astype(kind)
            dense.offer_all(part, where)
            group, col = np.nonzero(part > -1)
            sparse.offer(group, part[group, col], where[col])
            assert len(dense.group) <= 5 * 7
        for found, least in ((dense, -9), (sparse, -0.9)):
            for g in range(5):
                expected = sorted((-s, kind(p) if kind is str else p) for s, p in zip(scores[g], places, strict=True) if s > least)[:7]
                assert [(-s, p) for s, p in zip(found.score[found.group == g], found.place[found.group == g], strict=True)] == expected


@pytest.mark.parametrize("common", [0, 2, 512])
def test_bm25_scores_chunks_where_they_are(spark, monkeypatch, common):
    """Common and rare terms, blocks of queries, small slices, and terms of negative weight, against all hits as rows."""
    monkeypatch.setattr(bm25, "COMMON", common)
    monkeypatch.setattr(bm25, "COMMON_SHARE", 4)
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 4)
    rng = random.Random(common)
    texts = [" ".join(rng.choices("abcdefghij", [64, 32, 16, 8, 4, 2, 1, 1, 1, 1], k=rng.randrange(12))) for _ in range(80)]
    for docs in (texts, ["a b", "a", "a c", "b a"]):  # of the latter the mean weight is negative
        chunks = spark.createDataFrame([(f"c{i:02}", 900 - i, t) for i, t in enumerate(docs)], "chunk_id string, ord int, text string").repartition(3)
        asked = spark.createDataFrame([(i, " ".join(rng.choices("abcdefghijz", k=3))) for i in range(9)], "query_id int, text string")
        index = bm25.build(chunks)
        hits = {(r["query_id"], r["chunk_id"]): r["score"] for r in bm25.scores(index, asked).collect()}
        got = bm25.top_k(index, asked, 6).orderBy("query_id", "rank").collect()
        for q in range(9):
            ranked = sorted((-hits.get((q, f"c{i:02}"), 0.0), -i) for i in range(len(docs)))[:6]
            assert [(r["chunk_id"], r["score"]) for r in got if r["query_id"] == q] == [(f"c{-i:02}", pytest.approx(-s, abs=1.1e-6)) for s, i in ranked]


def test_vectors_in_slices(spark, monkeypatch):
    """A slice is bounded by its scores: many queries see few vectors at a time."""
    seen = best.slice_rows(4096)
    assert seen * 4096 <= best.CELLS and vector.QUERY_BLOCK <= 4096
    rng = np.random.default_rng(2)
    e = rng.integers(-1, 2, (60, 3)).astype(float)
    rows = [(f"v{i}", x.tolist()) for i, x in enumerate(e)]
    v = spark.createDataFrame(rows, "chunk_id string, embedding array<double>")
    got = vector.top_k(v, v.withColumnRenamed("chunk_id", "query_id"), 5).orderBy("query_id", "rank").collect()
    norm = np.linalg.norm(e, axis=1)
    for i in range(60):
        if norm[i] > 0:
            ranked = sorted((-round(float(e[i] @ e[j] / norm[i] / norm[j]), 9) + 0.0, f"v{j}") for j in range(60) if norm[j] > 0)[:5]
            assert [(r["chunk_id"], r["score"]) for r in got if r["query_id"] == f"v{i}"] == [(j, pytest.approx(-s)) for s, j in ranked]


def test_equal_vectors_are_searched_once(spark, monkeypatch):
    """Queries that share a vector share a search, and each gets its whole result."""
    rng = np.random.default_rng(4)
    stored = rng.integers(-2, 3, (300, 4)).astype(float)
    asked = rng.integers(-1, 2, (3, 4)).astype(float) + 0.5
    v = spark.createDataFrame([(f"c{i}", x.tolist()) for i, x in enumerate(stored)], "chunk_id string, embedding array<float>")
    q = spark.createDataFrame([(i, asked[i % 3].tolist()) for i in range(40)] + [(99, None)], "query_id long, embedding array<float>")
    monkeypatch.setattr(vector, "QUERY_BLOCK", 3)
    got = vector.top_k(v, q, 7)
    searches = got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")
    assert searches == 1
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append((r["chunk_id"], r["score"]))
    norm = np.linalg.norm(stored, axis=1)
    for i in range(40):
        x = asked[i % 3] / np.linalg.norm(asked[i % 3])
        scores = sorted((-round(float(x @ s / n), 9), f"c{c}") for c, (s, n) in enumerate(zip(stored, norm)) if n)
        assert [c for c, _ in found[i]] == [c for _, c in scores[:7]]
    assert set(found) == set(range(40))


def test_hashed_words():
    """Vectors of many texts at once are those of one after the other."""
    import zlib

    texts = ["A b  a\tc", None, "", " \n", "ünï A a b's", "x " * 50]
    expected = np.zeros((len(texts), 8), np.float32)
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = zlib.crc32(w.encode())
            expected[i, h % 8] += 1 if h >> 16 & 1 else -1
    assert (vector._hashed(texts, 8) == expected).all()
    assert vector._hashed([None], 8).tolist() == [[0] * 8] and vector._hashed([], 8).shape == (0, 8)


def test_blocks_of_many_signatures_are_halved(spark, monkeypatch):
    """Questions that share common terms go to the index at once, others in smaller blocks; results are the same."""
    texts = [f"a{'  b' * (i % 3)} c{i % 5} d{i}" for i in range(60)]
    index = bm25.build(spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "chunk_id long, ord long, text string"))
    asked = spark.createDataFrame([(i, f"a c{i % 5} d{i}" + " b" * (i % 4)) for i in range(40)], "query_id long, text string")
    scans = []
    real = bm25._block
    monkeypatch.setattr(bm25, "_block", lambda index, some, first, k: scans.append(len(some)) or real(index, some, first, k))
    rows = lambda: sorted(map(tuple, bm25.top_k(index, asked, 6).collect()))
    whole = rows()
    assert scans == [40]
    monkeypatch.setattr(bm25, "SIGNATURES", 6)
    assert rows() == whole and len(scans) > 3
