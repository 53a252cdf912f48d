import hashlib

import numpy as np
import pytest

from ferrule.llm import suffix_dedup


def brute(rows, length=suffix_dedup.LENGTH):
    """Strings in order of document and start; a later equal one covers its bytes."""
    docs = {}
    for i, t in rows:
        docs.setdefault((i is not None, i or 0, (t or "").encode()))
    seen, out = set(), {}
    for has, i, text in sorted(docs):
        marks = np.zeros(len(text) + 1, int)
        for p in range(len(text) - length + 1):
            s = text[p : p + length]
            if s in seen:
                marks[p] += 1
                marks[p + length] -= 1
            seen.add(s)
        gone = np.cumsum(marks[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        out[i if has else None, text] = (len(text), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def check(df, rows):
    expected = brute(rows)
    want = sorted(((i, *expected[i, (t or "").encode()]) for i, t in rows), key=repr)
    got = suffix_dedup.suffix_dedup(df).collect()
    assert sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got), key=repr) == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


@pytest.mark.parametrize("common", [5_000, 1])
def test_documents(documents, rows, small_tasks, monkeypatch, common):
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    check(documents, rows)


def test_ids_of_one_text_only(spark, small_tasks):
    """Awkward rows, each id with one text (the order of two texts of one id is a hash's)."""
    from tests.llm.conftest import ROWS

    rows = [r for r in ROWS if r[0] is not None] + [(None, ROWS[8][1])]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_awkward(awkward, empty):
    assert suffix_dedup.suffix_dedup(awkward).count() == awkward.count()
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_periodic_text(spark, small_tasks):
    rows = [(1, "ab" * 300), (2, "x" + "ab" * 100), (3, "a" * 99), (4, "a" * 100), (5, "b" + "a" * 101)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_anchors_cover_every_string():
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 100, 3000).astype(np.uint8)
    starts = np.array([0, 50, 150, 1100, 3000])
    at, _, first, last = suffix_dedup.anchors(raw, starts)
    covered = sorted(p for f, s in zip(first.tolist(), last.tolist()) for p in range(f, s + 1))
    assert covered == [p for a, b in zip(starts[:-1], starts[1:]) for p in range(a, b - 99)]
    assert all(f <= a <= f + 76 and s <= a for a, f, s in zip(at.tolist(), first.tolist(), last.tolist()))


def test_identifiers():
    raw = np.frombuffer(b"abcabcabd", np.uint8)
    ids = suffix_dedup.identifiers(raw, 3)
    assert ids[0] == ids[3] and ids[0] != ids[6] and len(ids) == 7


def test_refined():
    rng = np.random.default_rng(1)
    for length in (8, 9, 24, 100):
        sizes = rng.integers(0, 300, 40)
        base = rng.integers(97, 99, 400).astype(np.uint8)
        pieces = [base[(a := int(rng.integers(0, 100))) : a + n] for n in sizes.tolist()]
        raw = np.concatenate(pieces)
        at, bucket = suffix_dedup.refined(raw, sizes, length)
        starts = np.cumsum(sizes) - sizes
        strings = {int(b + p): piece[p : p + length].tobytes() for b, piece in zip(starts, pieces) for p in range(len(piece) - length + 1)}
        groups = {}
        for p, t in strings.items():
            groups.setdefault(t, set()).add(p)
        found = {}
        for p, b in zip(at.tolist(), bucket.tolist()):
            found.setdefault(b, set()).add(p)
        assert sorted(map(sorted, found.values())) == sorted(sorted(g) for g in groups.values() if len(g) > 1)


def test_refined_nothing():
    at, bucket = suffix_dedup.refined(np.zeros(0, np.uint8), np.zeros(0, np.int64), 100)
    assert len(at) == len(bucket) == 0


@pytest.mark.parametrize("part", [1, 1000])
def test_parts(spark, small_tasks, monkeypatch, part):
    """Some q-grams at a time; a passage shared at many offsets, with copies in other runs."""
    monkeypatch.setattr(suffix_dedup, "PART", part)
    rng = np.random.default_rng(2)
    shared = bytes(rng.integers(97, 123, 400).astype(np.uint8)).decode()
    rows = []
    for i in range(120):
        a, b = sorted(rng.integers(0, 400, 2).tolist())
        own = bytes(rng.integers(97, 123, 300).astype(np.uint8)).decode()
        rows.append((i, own + shared[a:b] + own[:150]))
    rows += rows[::9] + [(None, rows[3][1])]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
