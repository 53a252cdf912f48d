import hashlib
import re
from collections import defaultdict

from ferrule.llm import line_dedup


def brute(rows, least_chars=40, least_docs=5):
    low = lambda i: line_dedup.NO_ID if i is None else i
    key = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", s))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(low(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [s for s in lines if len(held.get(key(s), ())) < least_docs or low(i) == max(held[key(s)])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    rows = line_dedup.line_dedup(df).collect()
    assert all(hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"] for r in rows)
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in rows), key=repr)


def test_documents(documents, rows):
    assert got(documents) == brute(rows)


def test_awkward(awkward, empty):
    assert got(awkward) == brute([(r["doc_id"], r["text"]) for r in awkward.collect()])
    assert got(empty) == []


def test_shared_lines(spark):
    line = "This very line of text is shared by many documents."
    exact, short = "x" * 40, "x" * 39
    rows = [(i, f"{i}\n \t{line.upper() if i % 2 else line}\r\n{line}\n{exact}\n{short}") for i in range(6)] + [(None, line), (5, line), (9, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == brute(rows)
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(df.withColumn("n_chars", df.doc_id)).collect()}
    assert out[0]["text"] == "0\n" + short and out[0]["n_chars"] == len(out[0]["text"]) and out[5]["n_chars"] > 40


def test_columns_stay(awkward, empty):
    assert line_dedup.dedup_lines(awkward).dtypes == awkward.dtypes
    assert line_dedup.dedup_lines(awkward).count() == awkward.count()
    assert line_dedup.dedup_lines(empty).count() == 0


def test_least_id(spark):
    """The least possible id counts as null does: the two are one document."""
    line = "This very line of text is shared by many documents."
    rows = [(None, line), (line_dedup.NO_ID, line + "\nmore"), *((i, line) for i in range(3))]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    rows.append((7, line))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
