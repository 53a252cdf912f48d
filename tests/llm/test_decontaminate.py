import hashlib
import re

from ferrule.llm import decontaminate as d


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(rows, items, window=13):
    wins = set()
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        wins |= {(tuple(w[i : i + k]), item) for i in range(len(w) - k + 1) if k}
    by = {}
    for g, item in wins:
        by.setdefault(g, set()).add(item)
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for k in {len(g) for g in by}:
            for p in range(len(w) - k + 1):
                if (g := tuple(w[p : p + k])) in by:
                    hit |= set(range(p, p + k))
                    found |= by[g]
        names = sorted({str(x) for x in found if x is not None})
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(docs, items, **more):
    return sorted((tuple(r)[:6] for r in d.decontaminate(docs, items, **more).collect()), key=repr)


def test_documents(spark, sf, documents, rows):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    pairs = [(r["item_id"], r["text"]) for r in items.collect()]
    assert got(documents, items) == brute(rows, pairs)
    assert got(documents, items, block_words=200) == brute(rows, pairs)


ITEMS = [(1, "one two"), (1, "One, TWO!"), (2, "lorem"), (3, None), (4, ""), (5, "..."), (None, "same same same"), (6, "a b a b a b a b a b a b a b a b"), (7, " ".join(f"w{i}" for i in range(30)))]


def test_awkward(spark, awkward, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert got(awkward, items) == brute(rows, ITEMS)
    assert got(empty, items) == []
    assert got(awkward, items.limit(0)) == brute(rows, [])
    kept = d.keep_clean(awkward, items)
    assert kept.dtypes == awkward.dtypes
    bad = [r for r in brute(rows, ITEMS) if r[5]]
    assert bad and kept.count() == len(rows) - len(bad)


def test_overlaps(spark):
    """Windows that begin before an earlier match ended, and short items inside long ones."""
    w = [f"w{i}" for i in range(30)]
    items = [(1, " ".join(w)), (2, " ".join(w[5:8])), (3, " ".join([*w[10:23], "z"])), (4, "q " + " ".join(w[:13]))]
    rows = [(1, " ".join(w)), (2, " ".join(w[3:20])), (3, " ".join(w[:12])), (4, "x " + " ".join(w[4:9]) + " y"), (5, "q " + " ".join(w[:20]) + " " + " ".join(w[10:23]) + " z"), (6, " ".join(w[:13] * 2))]
    make = lambda x, k: spark.createDataFrame(x, f"{k} long, text string")
    for window in (13, 2, 5):
        assert got(make(rows, "doc_id"), make(items, "item_id"), window=window) == brute(rows, items, window)


def test_spans_are_cut():
    text = "Keep this. One, two three! And this."
    assert d.without_spans(text, [2, 5]) == "Keep this. ! And this."
    assert d.without_spans(text, []) == text
