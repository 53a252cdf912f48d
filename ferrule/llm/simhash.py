"""SimHash near-dedup over a distributed vantage-point tree.

Distinct fingerprints are dealt to the leaves (shards) of a vantage-point tree
that is fitted on a bounded sample.  A fingerprint lives in one shard and
visits every later shard that its ball of the link radius overlaps by the
triangle inequality, so that each linked pair meets exactly once.  Within a
shard a second tree finds the pairs; only a spanning forest of them leaves it.
Forests are joined by star contraction.

The pipeline's stage asks for more than fingerprints can tell apart: texts of
Jaccard similarity 0.8 differ in about ten of 64 bits, and balls of such a radius
overlap nearly every shard.  There candidates come from bands of minima, and
each link is an exact comparison of shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import materialise
from ._text import LOWER, flat, mixed, runs_of, slices, space_words, span_hashes, texts_of, word_bounds

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints that the shard tree is fitted on, at most.
SAMPLE = 16_384
#: Fingerprints to a shard, about.
SHARD_ROWS = 8_192
LEAF = 128
#: Near copies of the pipeline's stage: words to a shingle, and the least Jaccard similarity in hundredths.
NEAR_SHINGLE, SIMILARITY = 5, 80
#: Candidates share all ``ROWS`` minima of one of ``BANDS`` bands.
BANDS, ROWS = 24, 5
#: 64-bit words of a map of shingles, a power of two.
MAP_WORDS = 8
_LOWER = np.frombuffer(LOWER, np.uint8)


def fingerprint(text: bytes) -> int:
    """A bit is set if it is in over half the hashes of the text's shingles."""
    words = space_words(text)
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        marks = np.array([fingerprint(t) for t in texts_of(batch.column("text"))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks.view(np.int64))], names=["doc_id", "fp"])


class VantageTree:
    """Partitions 64-bit fingerprints by their Hamming distance to vantage points."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.nodes: list[tuple | np.ndarray] = []
        self.leaves = 0
        self._build(points, np.arange(len(points)), leaf)

    def _build(self, points: np.ndarray, own: np.ndarray, leaf: int) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        split = self._split(points[own]) if len(own) > leaf else None
        if split is None:
            self.nodes[at] = (self.leaves, own)
            self.leaves += 1
            return at
        vantage, threshold = split
        near = np.bitwise_count(points[own] ^ vantage) < threshold
        left = self._build(points, own[near], leaf)
        right = self._build(points, own[~near], leaf)
        self.nodes[at] = (vantage, threshold, left, right)
        return at

    @staticmethod
    def _split(points: np.ndarray) -> tuple[np.uint64, int] | None:
        """Of a few vantage points, the one whose middle thresholds the fewest balls would overlap."""
        best = None
        n = len(points)
        for k in range(8):
            vantage = points[(k * 2_654_435_761) % n]
            counts = np.bincount(np.bitwise_count(points ^ vantage), minlength=66)
            below = np.concatenate([[0], np.cumsum(counts)])
            for t in range(1, 65):
                if 0.3 * n <= below[t] <= 0.7 * n:
                    crossed = below[min(t + RADIUS, 65)] - below[max(t - RADIUS, 0)]
                    cost = crossed + abs(2 * below[t] - n) / 4
                    if best is None or cost < best[0]:
                        best = (cost, vantage, t)
        if best is None:  # no threshold is near the middle: any that splits
            for k in range(n):
                d = np.bitwise_count(points ^ points[k])
                t = int(d.max())
                if t and 0 < (d < t).sum() < n:
                    return points[k], t
                if k > 8:
                    return None
            return None
        return best[1], best[2]

    def visit(self, queries: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each leaf: its number, its points' places, and which queries' balls may overlap it."""
        stack = [(0, np.arange(len(queries)))]
        while stack:
            at, which = stack.pop()
            node = self.nodes[at]
            if len(node) == 2:
                yield node[0], node[1], which
                continue
            vantage, threshold, left, right = node
            d = np.bitwise_count(queries[which] ^ vantage).astype(np.int16)
            for child, go in ((left, which[d - radius < threshold]), (right, which[d + radius >= threshold])):
                if len(go):
                    stack.append((child, go))


def components(n: int, a: np.ndarray, b: np.ndarray, labels: np.ndarray | None = None) -> np.ndarray:
    """The smallest node of each node's component, by min-label hooking and pointer jumping."""
    labels = np.arange(n) if labels is None else labels.copy()
    while len(a):
        x, y = labels[a], labels[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(labels, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up
    return labels


def _forest(table: pa.Table) -> pa.Table:
    """Edges from each fingerprint to the smallest of its component within the shard."""
    points = table.column("fp").to_numpy().view(np.uint64)
    home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
    order = np.concatenate([np.flatnonzero(home), np.flatnonzero(~home)])
    points, settled = points[order], int(home.sum())
    labels = np.arange(len(points))
    if settled:
        tree = VantageTree(points[:settled], LEAF)
        pairs: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for _, own, which in tree.visit(points, RADIUS):
            for block in np.array_split(which, max(1, len(which) * len(own) // 4_000_000 + 1)):
                i, j = np.nonzero(np.bitwise_count(points[block][:, None] ^ points[own][None, :]) <= RADIUS)
                i, j = block[i], own[j]
                keep = i > j
                pairs.append((i[keep], j[keep]))
                held += int(keep.sum())
                if held > 1_000_000:
                    labels = components(len(points), *map(np.concatenate, zip(*pairs, strict=True)), labels)
                    pairs, held = [], 0
        if pairs:
            labels = components(len(points), *map(np.concatenate, zip(*pairs, strict=True)), labels)
    moved = np.flatnonzero(labels != np.arange(len(points)))
    signed = points.view(np.int64)
    return pa.table({"a": signed[moved], "b": signed[labels[moved]]})


def _route(batches: Iterator[pa.RecordBatch], tree: VantageTree) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        homes = np.zeros(len(points), np.int32)
        for leaf, _, which in tree.visit(points, 0):
            homes[which] = leaf
        shard, fp, home = [homes], [points], [np.ones(len(points), bool)]
        for leaf, _, which in tree.visit(points, RADIUS):
            guests = which[homes[which] < leaf]
            shard.append(np.full(len(guests), leaf, np.int32))
            fp.append(points[guests])
            home.append(np.zeros(len(guests), bool))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(shard)), pa.array(np.concatenate(fp).view(np.int64)), pa.array(np.concatenate(home))], names=["shard", "fp", "home"]
        )


def _contract(edges: DataFrame) -> DataFrame:
    """``v, root`` for every node of the edges ``a, b``: root is the component's smallest node.

    Large-star and small-star steps in turn, each step's edges written to the
    shared folder, until none changes.
    """

    def starred(edges: DataFrame, both: bool) -> DataFrame:
        low = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        near = low.unionByName(low.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else low
        least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        joined = near.join(least, "u")
        if both:  # each larger neighbour to the smallest
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:  # each smaller neighbour, and the node itself, to the smallest
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialise(edges.where("a <> b").distinct(), "edges")
    seen = mark(edges)
    while seen[0]:
        edges = materialise(starred(starred(edges, True), False), "edges")
        before, seen = seen, mark(edges)
        if before == seen:
            break
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp``: the fingerprint of each row's text, as a signed 64-bit number."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def link_components(marks: DataFrame) -> DataFrame:
    """``fp, component_id`` for the distinct fingerprints of ``marks`` (``doc_id, fp``)."""
    distinct = materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    n = distinct.count()
    sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    shards = max(1, -(-n // SHARD_ROWS))
    tree = VantageTree(sample, max(2, len(sample) // shards)) if shards > 1 else VantageTree(sample, len(sample) + 1)
    for i, node in enumerate(tree.nodes):  # leaves need no points to route by
        if len(node) == 2:
            tree.nodes[i] = (node[0], None)
    routed = distinct.select("fp").mapInArrow(lambda b: _route(b, tree), "shard int, fp long, home boolean")
    edges = routed.groupBy("shard").applyInArrow(_forest, "a long, b long")
    roots = _contract(edges)
    nodes = roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct())
    members = nodes.join(distinct, F.col("v") == F.col("fp")).select("fp", "root", "least")
    lowest = members.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = members.join(lowest, "root").select("fp", "component_id")
    return distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Documents link when their fingerprints differ in at most ``RADIUS`` bits;
    ``component_id`` is the smallest ``doc_id`` that links reach, the document's
    own included.

    Null, empty and blank texts have the fingerprint zero and link like others;
    under three words make one shingle.  Null ids have a component but never
    name it (a component of null ids alone has a null name).  Rows that repeat
    an id are kept, row by row; other columns are not read.  An empty table
    gives an empty table.  A text is handled in one piece, whatever its length.
    """
    marks = materialise(fingerprints(docs), "marks")
    # stored, so that the join below has an exchange on either side and adaptive execution can split a text with very many copies
    linked = materialise(link_components(marks), "linked")
    return marks.join(linked, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands of ``n`` 32-bit hash functions, each a column."""
    x = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) + np.uint64(SEED << 32)).astype(np.uint32)
    return x[:n, None] | np.uint32(1), x[n:, None]


_FUNCTIONS = _hashes(BANDS * ROWS)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text the ascending hashes of its distinct runs of ``NEAR_SHINGLE`` words; of all its words if it has fewer."""
    raw, starts = flat(column)
    raw = _LOWER[raw]
    first, last = word_bounds(raw, starts)
    words = span_hashes(raw, first, last)
    runs = runs_of(words, NEAR_SHINGLE)
    cuts = np.searchsorted(first, starts)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield np.unique(runs[a : b - NEAR_SHINGLE + 1] if b - a >= NEAR_SHINGLE else runs_of(words[a:b], max(b - a, 1)))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of ``ROWS`` minima of hash functions; the empty set has no keys."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    factors, summands = _FUNCTIONS
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 4096):
        np.minimum(least, (short[None, at : at + 4096] * factors + summands).min(axis=1), out=least)
    out = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def _near_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sets = list(shingle_sets(batch.column("text")))
        fp = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
        keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
        sim = pa.concat_arrays([b.column("fp") for b in _fingerprints(iter([batch.select(["doc_id", "text"])]))])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), pa.array(fp), keys, sim], names=["doc_id", "copy", "fp", "keys", "sim"])


def _near_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array([s.tobytes() for s in shingle_sets(batch.column("text"))], pa.binary())], names=["fp", "shingles"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose shingle sets have at least ``SIMILARITY`` of their union in common."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.sort(np.concatenate([x, y]))
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= SIMILARITY * (len(both) - common))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("shingles")
        sizes = [len(x) // 8 for x in column.to_pylist()]
        shingles = np.frombuffer(b"".join(column.to_pylist()), np.int64)
        fp = np.repeat(batch.column("fp").to_numpy(), sizes)
        for at in range(0, len(fp), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(fp[at : at + (1 << 16)]), pa.array(shingles[at : at + (1 << 16)])], names=["fp", "shingle"])


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The size of each set, and the map whose bits its shingles toggle."""
    for batch in batches:
        sets = [np.frombuffer(x, np.uint64) for x in batch.column("shingles").to_pylist()]
        maps = np.zeros((len(sets), MAP_WORDS), np.uint64)
        for i, x in enumerate(sets):
            np.bitwise_xor.at(maps[i], (x >> np.uint64(6)) % np.uint64(MAP_WORDS), np.uint64(1) << (x & np.uint64(63)))
        columns = [pa.array(np.ascontiguousarray(maps[:, i]).view(np.int64)) for i in range(MAP_WORDS)]
        yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array([len(x) for x in sets], pa.int64()), *columns], names=["fp", "size", *(f"w{i}" for i in range(MAP_WORDS))])


def near_components(docs: DataFrame) -> DataFrame:
    """``doc_id, copy, root, component_id`` for the distinct ids and texts of ``docs`` (``doc_id, copy, text``; ``copy`` is a hash of the text).

    Texts link when the Jaccard similarity of their sets of five-word shingles is
    0.8 or more.  SimHash comes first: fingerprints that link, by vantage-point
    trees as in ``op1_simhash``, name for each set the first one of its component,
    and the two sets are compared in full.  What these links leave apart goes by
    bands of minima: sets that share one are candidates (at 0.8 a pair is one with
    probability 0.99993) and are compared in full, in rounds: each
    set with one random member of each of its buckets; then with the member that
    shares most of its shingles with others; then all pairs of a bucket that no
    chain of links joins yet.  After the first round sets are left out that
    cannot link: of x's shingles only those that another open set has too can be
    common to x and y, so that the similarity is at most m / (|x| + |y| - m), m
    being the smaller number of these.  ``root`` names the component,
    ``component_id`` is its smallest ``doc_id``.
    """
    marks = materialise(docs.mapInArrow(_near_marks, "doc_id long, copy long, fp long, keys array<long>, sim long"), "near-marks")
    least = F.min(F.struct("doc_id", "copy")).alias("least")
    distinct = materialise(marks.groupBy("fp").agg(least, F.first("keys").alias("keys"), F.min("sim").alias("sim")).select("fp", "least.*", "keys", "sim"), "near-distinct")
    close = link_components(distinct.select(F.col("fp").alias("doc_id"), F.col("sim").alias("fp")))
    hashed = distinct.select("fp", "sim").join(close.select(F.col("fp").alias("sim"), F.col("component_id").alias("leader")), "sim").where("fp <> leader")
    hashed = materialise(hashed.select(F.greatest("fp", "leader").alias("a"), F.least("fp", "leader").alias("b")), "near-hashed")
    keyed = distinct.select("fp", F.explode("keys").alias("key"))
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("fp", "key"), "fp")).getField("fp").alias("leader")).where("n > 1")
    keyed = materialise(keyed.join(buckets.select("key", "leader"), "key"), "near-keyed")

    either = keyed.select("fp").unionByName(hashed.select(F.explode(F.array("a", "b")).alias("fp")))
    wanted = either.distinct().join(distinct, "fp").select("fp", "doc_id", "copy")
    sets = docs.join(wanted, ["doc_id", "copy"]).select("fp", "text").mapInArrow(_near_sets, "fp long, shingles binary")
    sets = materialise(sets.groupBy("fp").agg(F.first("shingles").alias("shingles")), "near-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        one = pairs.join(sets.select(F.col("fp").alias("a"), F.col("shingles").alias("x")), "a")
        two = one.join(sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y")), "b")
        return two.select("a", "b", "x", "y").mapInArrow(_similar, "a long, b long")

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.greatest("fp", "leader").alias("a"), F.least("fp", "leader").alias("b")).distinct()

    def joined(roots: DataFrame, pairs: DataFrame) -> DataFrame:
        return materialise(_contract(roots.select(F.col("v").alias("a"), F.col("root").alias("b")).unionByName(verified(pairs))), "near-roots")

    def apart(keyed: DataFrame, roots: DataFrame) -> DataFrame:
        """The rows of buckets whose members are not all of one component."""
        labelled = keyed.join(roots.withColumnRenamed("v", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        several = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
        return labelled.join(several, "key")

    roots = materialise(_contract(verified(hashed)), "near-roots")
    far = apart(keyed.select("key", "fp"), roots).join(keyed, ["key", "fp"]).where("fp <> leader")
    led = materialise(ordered(far.select("fp", "leader")).join(hashed, ["a", "b"], "left_anti"), "near-led")
    roots = joined(roots, led)
    open_ = materialise(apart(keyed.select("key", "fp"), roots), "near-open")

    members = materialise(open_.select("fp").distinct().join(sets, "fp"), "near-members")
    shingles = members.mapInArrow(_shingle_rows, "fp long, shingle long")
    words = [f"w{i}" for i in range(MAP_WORDS)]
    toggled = [F.bit_xor(F.when(F.shiftright("shingle", 6).bitwiseAND(MAP_WORDS - 1) == i, F.expr("shiftleft(1L, int(shingle & 63))")).otherwise(F.lit(0).cast("long"))).alias(w) for i, w in enumerate(words)]
    lone = shingles.groupBy("shingle").agg(F.min("fp").alias("fp"), F.max("fp").alias("other")).where("fp = other")
    lone = lone.groupBy("fp").agg(F.count("*").alias("lone"), *toggled)
    sketch = members.mapInArrow(_sketches, "fp long, size long, " + ", ".join(f"{w} long" for w in words)).alias("s").join(lone.alias("l"), "fp", "left")
    shared = sketch.select("fp", "size", F.coalesce("lone", F.lit(0)).alias("lone"), *(F.col(f"s.{w}").bitwiseXOR(F.coalesce(f"l.{w}", F.lit(0).cast("long"))).alias(w) for w in words))
    shared = materialise(shared.where((100 - SIMILARITY) * F.col("size") >= 100 * F.col("lone")), "near-shared")

    def may_link(x: str, y: str) -> Column:
        differ = reduce(add, (F.bit_count(F.col(f"{x}.{w}").bitwiseXOR(F.col(f"{y}.{w}"))) for w in words), F.col(f"{x}.lone") + F.col(f"{y}.lone"))
        return (100 + SIMILARITY) * differ <= (100 - SIMILARITY) * (F.col(f"{x}.size") + F.col(f"{y}.size"))

    held = materialise(open_.select("key", "fp").join(shared, "fp"), "near-held")
    central = held.groupBy("key").agg(F.min(F.struct(F.col("lone") / F.col("size"), "fp", "size", "lone", *words)).alias("m")).select("key", "m.size", "m.lone", *(f"m.{w}" for w in words), F.col("m.fp").alias("leader"))
    around = apart(held, roots).alias("x").join(central.alias("y"), "key").where(may_link("x", "y")).where("fp <> leader").select("fp", "leader")
    around = materialise(ordered(around).join(led, ["a", "b"], "left_anti"), "near-around")
    roots = joined(roots, around)

    rest = materialise(apart(held, roots), "near-rest")
    pair = rest.alias("x").join(rest.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") > F.col("y.fp")) & (F.col("x.root") != F.col("y.root")) & may_link("x", "y"))
    across = pair.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct().join(led, ["a", "b"], "left_anti").join(around, ["a", "b"], "left_anti")
    roots = joined(roots, materialise(across, "near-across"))

    nodes = roots.unionByName(roots.select(F.col("root").alias("v"), "root").distinct())
    members = distinct.select("fp", "doc_id").join(nodes.withColumnRenamed("v", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    lowest = members.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    linked = materialise(members.join(lowest, "root").select("fp", "root", "component_id"), "near-linked")
    return marks.join(linked, "fp").select("doc_id", "copy", "root", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """``docs``, with all its columns, less all but one row of each component of near copies.

    The row with the smallest ``doc_id`` stays; of several the one whose text has
    the smallest hash, and of rows that repeat id and text any one.  Rows without
    an id stay and link nothing.  Empty texts have no shingles and are copies of
    each other.  An empty table stays empty.  A text is handled in one piece.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"))
    known = rows.where("_id IS NOT NULL").withColumn("_copy", F.xxhash64("_text"))
    linked = near_components(known.select(F.col("_id").alias("doc_id"), F.col("_copy").alias("copy"), F.col("_text").alias("text")))
    kept = linked.where("doc_id = component_id").groupBy(F.col("doc_id").alias("_id"), "root").agg(F.min("copy").alias("_copy")).select("_id", "_copy")
    first = F.row_number().over(Window.partitionBy("_id", "_copy").orderBy("_id"))  # as the join leaves them: no text is sorted
    one = known.select("_id", "_copy", "_doc").join(kept, ["_id", "_copy"]).withColumn("_n", first).where("_n = 1")
    return one.select("_doc").unionByName(rows.where("_id IS NULL").select("_doc")).select("_doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
