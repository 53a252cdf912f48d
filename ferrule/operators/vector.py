"""Dense retrieval: exact cosine over a table of vectors."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ferrule.operators.best import Best, slice_rows
from ferrule.sources.scratch import materialise

CANDIDATES = 20
DIMENSION = 64
#: Distinct query vectors that are held against the corpus at a time.
QUERY_BLOCK = 4_096
#: Candidates that leave a task at a time.
FOUND = 65_536


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null if either is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _hashed(texts: pd.Series, dimension: int) -> np.ndarray:
    """Vectors of some texts; a word that comes again is hashed once."""
    split = [(t or "").lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    coded = pa.array(list(chain.from_iterable(split)), pa.large_string()).dictionary_encode()
    h = np.array([zlib.crc32(w.encode()) for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]
    place = np.repeat(np.arange(len(split)), sizes) * dimension + h % dimension
    sums = np.bincount(place, np.where(h >> 16 & 1, 1.0, -1.0), len(split) * dimension)
    return sums.reshape(-1, dimension).astype(np.float32)


def hash_embedding(text: Column, dimension: int = DIMENSION) -> Column:
    """A deterministic stand-in for a model: signed word counts, by hash.

    An iterator UDF over Arrow batches, as a model would be run: it is set up once
    for a worker, not for a batch.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(_hashed(texts, dimension)))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<float>")(text)


def embed(df: DataFrame, column: str = "text", dimension: int = DIMENSION) -> DataFrame:
    """``df`` with ``embedding`` of a text column."""
    return df.withColumn("embedding", hash_embedding(F.col(column), dimension))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """``old`` with the rows of ``new`` in place of those of the same key; of several the last by ``ord``."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_new"), F.desc("ord")))
    return both.withColumn("_n", last).where("_n = 1").drop("_n", "_new")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the ``k`` nearest of ``vectors`` (``chunk_id, embedding``) to each of ``queries`` (``query_id, embedding``).

    Queries that have the same vector are searched for once.  Distinct ones go to the
    vectors in blocks of ``QUERY_BLOCK``; each partition of vectors keeps ``k``
    candidates of each in numpy, some vectors at a time, so that the shuffle is of
    candidates alone and no pair but those is ever a row.
    """
    spark = vectors.sparkSession
    asked = materialise(queries.where(F.col("embedding").isNotNull()).select("query_id", "embedding"), "vec-asked")
    distinct = materialise(asked.select("embedding").distinct().withColumn("g", F.monotonically_increasing_id()), "vec-distinct")
    key = vectors.schema["chunk_id"].dataType
    kept = pa.schema([("g", pa.int64()), ("chunk_id", to_arrow_type(key)), ("score", pa.float64())])
    found, block = [], []

    def search(rows: list[Row]) -> None:
        matrix = np.array([r["embedding"] for r in rows], np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
        sent = spark.sparkContext.broadcast((np.array([r["g"] for r in rows], np.int64), matrix))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            numbers, matrix = sent.value
            best, step = Best(len(numbers), k), slice_rows(len(numbers))
            for whole in batches:
                whole = whole.filter(pc.is_valid(whole.column("embedding")))
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    x = b.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
                    keys = b.column("chunk_id").to_numpy(zero_copy_only=False)
                    norm = np.linalg.norm(x, axis=1)
                    x, keys = x[norm > 0] / norm[norm > 0, None], keys[norm > 0]
                    if len(keys):
                        best.offer_all(np.round(matrix @ x.T, 9), keys.astype(str) if keys.dtype == object else keys)
            for at in range(0, len(best.group), FOUND):
                group, place, score = (a[at : at + FOUND] for a in (best.group, best.place, best.score))
                yield pa.RecordBatch.from_arrays([pa.array(numbers[group]), pa.array(place.tolist(), kept.field("chunk_id").type), pa.array(score)], schema=kept)

        found.append(vectors.select("chunk_id", "embedding").mapInArrow(nearest, f"g long, chunk_id {key.simpleString()}, score double"))

    for row in distinct.toLocalIterator():
        block.append(row)
        if len(block) == QUERY_BLOCK:
            search(block)
            block = []
    if block:
        search(block)
    if not found:
        return vectors.select(F.lit(None).cast(queries.schema["query_id"].dataType).alias("query_id"), "chunk_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).limit(0)
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("score"), "chunk_id"))
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", rank).where(F.col("rank") <= k)
    return asked.join(distinct, "embedding").select("query_id", "g").join(ranked, "g").select("query_id", "chunk_id", "score", "rank")
