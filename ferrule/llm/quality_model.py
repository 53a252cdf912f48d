"""Quality classifier: ridge regression on random Fourier features of text statistics.

The cosines approximate a Gaussian kernel.  Normal equations are summed within
partitions and then on the driver; scores are calibrated by isotonic regression
over a histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import materialise
from ._text import flat, slices, span_hashes, word_bounds
from .quality_rules import _sums, measure

COSINES = 256
#: Width of the Gaussian kernel, in standard deviations of the statistics.
WIDTH = 4.0
RIDGE = 1e-3
#: Labelled documents that are learned from, at most: those with the least hashes of their ids.
LABELLED = 65_536
#: Partitions of these, whose sums the driver adds up.
SUMS = 32
BINS = 4096
SEED = 20_261
#: Labels are learned from documents with another remainder of crc32(doc_id).
FOLDS, HELD_OUT = 3, 1

_CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b"#*$%&|<>", b"!?", b".,;:", b"\n", b"@/_=+\\\"'()[]{}~^`-"]
_CLASS = np.full(256, len(_CLASSES), np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = len(_CLASSES) + 1
N_STATISTICS = len(_CLASSES) + 12


def statistics(column: pa.Array) -> np.ndarray:
    """A row of statistics for each text; null counts as empty."""
    raw, starts = flat(column)
    docs = len(starts) - 1
    size = np.maximum(np.diff(starts), 1)
    kinds = _CLASS[raw]
    shares = [np.sqrt(np.diff(_sums(kinds == k)[starts]) / size) for k in (*range(len(_CLASSES)), len(_CLASSES) + 1)]
    m = measure(column)
    words = np.maximum(m["n_words"], 1)
    first, last = word_bounds(raw, starts)
    doc_of = np.repeat(np.arange(docs), m["n_words"])
    keys = np.sort(span_hashes(raw, first, last) >> np.uint64(24) | doc_of.astype(np.uint64) << np.uint64(40))
    fresh = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    group_doc = (keys[fresh] >> np.uint64(40)).astype(np.int64)
    counts = np.diff(np.concatenate([fresh, [len(keys)]]))
    distinct = np.bincount(group_doc, minlength=docs)
    most = np.zeros(docs, np.int64)
    np.maximum.at(most, group_doc, counts)
    ends_with = kinds[last - 1]
    ended = [np.bincount(doc_of[ends_with == k], minlength=docs) / words for k in (3, 4)]
    caps = np.bincount(doc_of[(kinds[first] == 0) & (kinds[np.minimum(first + 1, last - 1)] == 0)], minlength=docs) / words
    squares = np.bincount(doc_of, weights=((last - first) ** 2).astype(float), minlength=docs) / words
    mean = m["word_chars"] / words
    return np.column_stack([
        *shares, np.log1p(m["n_words"]), np.log1p(mean), np.log1p(squares), m["n_repeat_words"] / words, np.minimum(m["ngram_share"], 10) / 10,
        m["line_share"], np.log1p(distinct) / np.log(words + 1.0 + (words == 1)), most / words, *ended, caps,
    ])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([r.tobytes() for r in rows.astype(np.float64)], pa.binary())], names=["doc_id", "stats"])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((3, N_STATISTICS))
    for batch in batches:
        x = _matrix(batch.column("stats"))
        total += [np.full(N_STATISTICS, len(x)), x.sum(0), (x * x).sum(0)]
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


class Model:
    """Standardised statistics, their cosines, ridge weights and calibration."""

    def __init__(self, total: np.ndarray):
        rng = np.random.default_rng(SEED)
        n = max(total[0, 0], 1)
        self.mean = total[1] / n
        self.spread = np.sqrt(np.maximum(total[2] / n - self.mean**2, 0)) + 1e-3
        self.turn = rng.normal(size=(N_STATISTICS, COSINES)) / WIDTH
        self.shift = rng.uniform(0, 2 * np.pi, COSINES)
        self.weights = np.zeros(COSINES + 1)
        self.at, self.rate = np.array([0.0]), np.array([0.5])

    def features(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.spread, -8, 8)
        return np.column_stack([np.sqrt(2 / COSINES) * np.cos(x @ self.turn + self.shift), np.ones(len(x))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.rate), 0, 1)

    def solve(self, total: np.ndarray) -> None:
        size = COSINES + 1
        gram, right = total[: size * size].reshape(size, size), total[size * size : size * size + size]
        penalty = np.full(size, RIDGE * max(total[-1], 1))
        penalty[-1] = 1e-9 * max(total[-1], 1)
        self.weights = np.linalg.solve(gram + np.diag(penalty), right)

    def calibrate(self, at: np.ndarray, rows: np.ndarray, good: np.ndarray) -> None:
        """Isotonic regression: neighbouring bins pool until the rates rise."""
        blocks: list[list[float]] = []
        for x, n, g in zip(at, rows, good, strict=True):
            blocks.append([x * n, n, g])
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
                last = blocks.pop()
                blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
        if blocks:
            self.at = np.array([b[0] / b[1] for b in blocks])
            self.rate = np.array([b[2] / b[1] for b in blocks])


def _normal(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    size = COSINES + 1
    gram, right, rows = np.zeros((size, size)), np.zeros(size), 0
    for batch in batches:
        z = model.features(_matrix(batch.column("stats")))
        gram += z.T @ z
        right += z.T @ batch.column("quality").to_numpy(zero_copy_only=False)
        rows += len(z)
    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([gram.ravel(), right, [rows]]).tobytes()], pa.binary())], names=["sums"])


def _binned(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw = model.raw(_matrix(batch.column("stats")))
        place = np.clip((raw + 0.5) / 2 * BINS, 0, BINS - 1).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(place), batch.column("quality")], names=["bin", "quality"])


def _scored(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = model.score(_matrix(batch.column("stats")))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])


def held_out(column: str = "doc_id"):
    """Whether a document's label is not to be learned from; a null id has none."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def learned_from(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, quality`` of at most ``LABELLED`` labelled documents that are not held out."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("quality"))
    found = known.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi")
    return materialise(found.orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED), "labels")


def fit(stats: DataFrame, known: DataFrame) -> Model:
    """Learn from the rows of ``stats`` (``doc_id, stats``) that ``known`` (``doc_id, quality``) has a label of.

    ``known`` has at most ``LABELLED`` rows and is broadcast.  The driver gets at
    most ``SUMS`` partial sums of fixed size, and a histogram of ``BINS`` bins.
    """
    rows = materialise(stats.join(F.broadcast(known), "doc_id").select("stats", "quality").repartition(SUMS), "labelled")

    def summed(df: DataFrame) -> np.ndarray:
        parts = [np.frombuffer(r["sums"]) for r in df.toLocalIterator()]
        return np.sum(parts, axis=0) if parts else np.zeros(0)

    total = summed(rows.coalesce(SUMS).mapInArrow(_moments, "sums binary"))
    model = Model(total.reshape(3, N_STATISTICS) if len(total) else np.zeros((3, N_STATISTICS)))
    if not len(total) or not total[0]:
        return model
    model.solve(summed(rows.coalesce(SUMS).mapInArrow(lambda b: _normal(b, model), "sums binary")))
    bins = rows.mapInArrow(lambda b: _binned(b, model), "bin int, quality double").groupBy("bin").agg(F.count("*").alias("n"), F.sum("quality").alias("good")).orderBy("bin").toPandas()
    model.calibrate((bins["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5, bins["n"].to_numpy(float), bins["good"].to_numpy(float))
    return model


def _stats(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measured, "doc_id long, stats binary")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``; ``labels`` has ``doc_id, quality``.

    Only the text's statistics enter a score.  Null and empty texts are scored
    as empty.  Null ids are never held out nor learned from.  Labels of null
    quality count for nothing; several labels of a document count as their
    mean; a repeated document counts again for each row.  Without any label to
    learn from every score is 0.5; of more than ``LABELLED`` labels a sample is
    learned from.  Other columns are not read.  An empty table gives an empty
    table.  A text is measured in one piece, with some 60 bytes of memory a byte.
    """
    stats = materialise(_stats(docs), "stats")
    model = fit(stats, learned_from(docs, labels))
    scored = stats.mapInArrow(lambda b: _scored(b, model), "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def _good(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        yield batch.filter(pa.array(model.score(statistics(batch.column("text"))) >= 0.5))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``quality_scores`` predicts to be good.

    Rows are judged one by one: nulls, repeats and an empty table as there.
    Texts are measured as they are filtered; beforehand only those learned from.
    """
    known = learned_from(docs, labels)
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    model = fit(_stats(some), known)
    return docs.mapInArrow(lambda b: _good(b, model), docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return quality_scores(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/labels.parquet"))
