import re

import numpy as np
import pyarrow as pa
import xxhash

from ferrule.llm import simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(pairs, radius=2):
    """Smallest id reachable, by flooding."""
    marks = np.array([f for _, f in pairs], np.uint64)
    near = np.bitwise_count(marks[:, None] ^ marks[None, :]) <= radius
    out = [None] * len(pairs)
    for i in range(len(pairs)):
        if out[i] is None:
            seen, todo = {i}, [i]
            while todo:
                for j in np.flatnonzero(near[todo.pop()]).tolist():
                    if j not in seen:
                        seen.add(j)
                        todo.append(j)
            ids = [pairs[j][0] for j in seen if pairs[j][0] is not None]
            for j in seen:
                out[j] = (min(ids) if ids else None,)
    return [o[0] for o in out]


def check(df, rows):
    pairs = [(i, brute_fingerprint(t)) for i, t in rows]
    expected = sorted(((i, format(f, "016x"), c) for (i, f), c in zip(pairs, brute_components(pairs))), key=repr)
    assert sorted(map(tuple, simhash.simhash_components(df).collect()), key=repr) == expected


def test_documents(documents, rows, small_tasks):
    check(documents, rows)


def test_one_shard(documents, rows):
    check(documents, rows)


def test_awkward(awkward, small_tasks):
    check(awkward, [(r["doc_id"], r["text"]) for r in awkward.collect()])


def test_empty(empty):
    assert simhash.simhash_components(empty).count() == 0
    assert simhash.keep_one_of_each(empty).columns == empty.columns


def test_one_stays(awkward):
    out = simhash.keep_one_of_each(awkward)
    assert out.schema.simpleString() == awkward.schema.simpleString()
    ids = [r["doc_id"] for r in out.collect()]
    assert ids.count(10) == 1 and ids.count(None) == 2 and {1, 2} & set(ids) == {1}


def test_dense_cloud(spark):
    """Hundreds of fingerprints a bit or two apart are one component; far ones are not drawn in."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(1 << 62))
    cloud = sorted({centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (600, 2))})
    far = [int(x) for x in rng.integers(1 << 62, size=500)]
    marks = np.array(cloud + far, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(enumerate(marks)), "doc_id long, fp long")
    old, simhash.SHARD_ROWS = simhash.SHARD_ROWS, 64
    try:
        got = {r["fp"]: r["component_id"] for r in simhash.link_components(df).collect()}
    finally:
        simhash.SHARD_ROWS = old
    expected = brute_components([(i, m & (1 << 64) - 1) for i, m in enumerate(marks)])
    assert [got[m] for m in marks] == expected


def test_chain(spark):
    """A long chain of links is one component."""
    marks, x = [0], 0
    for i in range(60):
        x ^= 1 << i
        marks.append(x)
    df = spark.createDataFrame([(i + 5, m) for i, m in enumerate(marks)], "doc_id long, fp long")
    assert {r["component_id"] for r in simhash.link_components(df).collect()} == {5}


def test_tree_finds_all_neighbours():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    points = np.unique(np.concatenate([base, base ^ np.uint64(5), base ^ np.uint64(1 << 40)]))
    tree = simhash.VantageTree(points, 8)
    found = set()
    for _, own, which in tree.visit(points, 2):
        i, j = np.nonzero(np.bitwise_count(points[which][:, None] ^ points[own][None, :]) <= 2)
        found |= set(zip(which[i].tolist(), own[j].tolist()))
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 2)
    assert found == set(zip(i.tolist(), j.tolist()))


def brute_near(texts):
    """The least place reachable by links of five-word Jaccard similarity 0.8 or more."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))})
    out = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if out[i] != out[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                low, high = sorted((out[i], out[j]))
                out = [low if x == high else x for x in out]
    return out


def edited(words, rng, n):
    words = list(words)
    for at in rng.choice(len(words), n, replace=False):
        words[at] = f"new{rng.integers(1 << 30)}"
    return " ".join(words)


def test_near_copies_go(spark):
    """Groups of texts with 0 to 12 of 150 words changed, from equal to well below the similarity; one text changed bit by bit."""
    rng = np.random.default_rng(8)
    texts = []
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 3000, 150)]
        texts += [edited(words, rng, n) for n in range(13)]
    words = [f"w{x}" for x in rng.integers(0, 3000, 150)]
    texts += [edited(words, rng, 2) for _ in range(60)]
    chain = [f"c{x}" for x in range(100)]
    for i in range(30):
        chain[3 * i] = f"d{i}"
        texts.append(" ".join(chain))
    texts += ["", "  ", "one two", "ONE two", "one", "a b c d e", "a b c d e f"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    expected = sorted({*brute_near(texts)})
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(df).collect()) == expected
    assert 100 < len(texts) - len(expected)


def test_bands_miss_few():
    """Of pairs at similarity 0.80 to 0.82 nearly all share a band."""
    rng = np.random.default_rng(5)
    missed = 0
    for _ in range(1500):
        pool = rng.integers(0, 1 << 63, 110, dtype=np.uint64)
        a, b = np.unique(pool[:99]), np.unique(pool[11:])  # 88 of 110
        missed += not (simhash.band_keys(a) == simhash.band_keys(b)).any()
    assert missed <= 3


def test_repeated_id_keeps_its_unique_text(spark):
    """Of an id with two texts, the copy of a smaller id goes and the unique text stays."""
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    df = spark.createDataFrame([(1, a), (2, b), (2, a), (3, b), (None, a)], "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, simhash.keep_one_of_each(df).collect()), key=repr) == sorted([(1, a), (2, b), (None, a)], key=repr)


def test_near_components_go_by_fingerprints_first(spark, monkeypatch):
    """Texts whose fingerprints link are joined without a band in common; what fingerprints leave apart is found by bands; a link that is not similar joins nothing."""
    monkeypatch.setattr(simhash, "_near_marks", _without_bands)
    rng = np.random.default_rng(5)
    long = " ".join(f"w{x}" for x in rng.integers(0, 10**6, 4000))
    texts = [long, long.replace(long.split()[2000], "other", 1), "a b c d e f g", "none of these words"]
    a, b = (next(simhash._fingerprints(iter([pa.RecordBatch.from_pydict({"doc_id": [0], "text": [t]})]))).column("fp")[0].as_py() for t in texts[:2])
    assert (a ^ b).bit_count() <= 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one_of_each(df).collect()) == [0, 2, 3]


_marks_with_bands = simhash._near_marks


def _without_bands(batches):
    for b in _marks_with_bands(batches):
        yield b.set_column(3, "keys", pa.array([[]] * b.num_rows, pa.list_(pa.int64())))
