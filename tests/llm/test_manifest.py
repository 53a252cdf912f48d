import hashlib

import pytest
from pyspark.sql import functions as F

from ferrule.llm import manifest

KIND = "doc_id long, source string, lang string, n_chars long, text string, node string, group string, at long, members string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))


def tree(nodes):
    """The root, and for each node its siblings to the left and right on each level."""
    proofs, own = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(own):
            run = range(a // 3 * 3, min(a // 3 * 3 + 3, len(nodes)))
            proofs[i].append(("".join(nodes[x] for x in run if x < a), "".join(nodes[x] for x in run if x > a)))
            own[i] = a // 3
        nodes = [sha("".join(nodes[i : i + 3])) for i in range(0, len(nodes), 3)]
    return nodes[0], proofs


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in by[s]]) for s in sources}
    root, above = tree([trees[s][0] for s in sources])
    return sorted(((r[0], leaf(r), trees[s][0], root, tuple(p + up)) for s, up in zip(sources, above, strict=True) for r, p in zip(by[s], trees[s][1], strict=True)), key=repr)


def got(df):
    def steps(proof):
        return tuple((bytes(s["left"]).hex(), bytes(s["right"]).hex()) for s in proof)

    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], steps(r["proof"])) for r in manifest.merkle_manifest(df).collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "n", "g", 3, "m") for r in rows], KIND).repartition(4)


def made(n, sources):
    return [(i * 7 % 101 - 20, sources[i % len(sources)], "en" if i % 3 else None, i, f"text {i}\n" * (i % 4) if i % 5 else None) for i in range(n)]


@pytest.mark.parametrize(("n", "sources"), [(1, ["a"]), (1, [None]), (2, ["a"]), (3, ["a", "b", None, "", "é", "z", "Z"]), (40, ["a", "a", "a", "b", None, "", "é", "z", "Z"]), (28, ["a"])])
def test_trees(spark, n, sources):
    rows = made(n, sources)
    assert got(table(spark, rows)) == brute(rows)


def test_awkward(spark, awkward, empty):
    """Null and repeated ids, rows that repeat, long and empty texts; a text that looks like fields."""
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in awkward.collect()]
    assert got(awkward) == brute(rows)
    assert got(empty) == []
    twins = [(1, "a", "en", 1, "x")] * 7 + [(1, "a", "en", 1, "y"), (None, None, None, None, None), (None, None, None, None, None), (2, "1:a-", "-", 0, "-")]
    assert got(table(spark, twins)) == brute(twins)


def test_ranges(spark, monkeypatch):
    """A source that is dealt to many ranges."""
    monkeypatch.setattr(manifest, "RANGE_ROWS", 10)
    rows = made(101, ["a", "a", "a", None])
    assert got(table(spark, rows)) == brute(rows)


def test_tampering(documents):
    """A changed row no longer leads to the root, a row as it was does."""
    changed = F.when(F.col("doc_id") % 3 == 0, manifest.leaf_digest(lang=F.concat("lang", F.lit("x"))))
    rows = manifest.merkle_manifest(documents, changed)
    rows = rows.withColumn("as_it_was", manifest.folded(F.col("leaf"), F.col("proof"))).withColumn("as_claimed", manifest.folded(F.coalesce("claimed", "leaf"), F.col("proof")))
    for r in rows.collect():
        assert r["as_it_was"] == r["root"]
        assert (r["as_claimed"] == r["root"]) == (r["doc_id"] % 3 != 0)
