"""Best-fit packing of documents into training sequences, under conflicts.

A sequence (bin) takes no two documents of one duplicate cluster and at most
``MOST_OF_SOURCE`` of one source.  Bins are ordered by what they have left; each
carries bitmaps of its clusters and sources, and the search goes on from the
tightest bin that has room to its successors until one is compatible.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices, space_words, texts_of

CAPACITY = 2048
MOST_OF_SOURCE = 2
#: Documents that are packed together, about.  Which ones is settled by a hash, so that a hot source or cluster is spread evenly.
SHARD_ROWS = 4096

SCHEMA = "doc_id long, piece int, start long, n_tokens int, bin_id long, bin_offset int"


class Bins:
    """Open bins, ordered by residual and number."""

    def __init__(self, capacity: int = CAPACITY, most_of_source: int = MOST_OF_SOURCE):
        self.capacity = capacity
        self.open: list[tuple[int, int]] = []
        self.clusters: list[int] = []
        #: For each bin: the sources it has at least once, twice, and so on.
        self.sources: list[list[int]] = []
        self.most = most_of_source

    def add(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Put an item into the tightest compatible bin; the bin's number and the item's offset."""
        source_bit, cluster_bit = 1 << source, 1 << cluster
        at = bisect_left(self.open, (size, -1))
        while at < len(self.open):
            left, number = self.open[at]
            if not self.clusters[number] & cluster_bit and not self.sources[number][-1] & source_bit:
                del self.open[at]
                break
            at += 1
        else:
            left, number = self.capacity, len(self.clusters)
            self.clusters.append(0)
            self.sources.append([0] * self.most)
        self.clusters[number] |= cluster_bit
        planes = self.sources[number]
        for i, plane in enumerate(planes):
            if not plane & source_bit:
                planes[i] |= source_bit
                break
        if left > size:
            insort(self.open, (left - size, number))
        return number, self.capacity - left


def pack(items: list[tuple[int | None, int, str | None, int]], capacity: int = CAPACITY, most_of_source: int = MOST_OF_SOURCE) -> list[tuple]:
    """Rows ``doc_id, piece, start, n_tokens, bin, offset`` for items ``doc_id, size, source, cluster``.

    A document larger than a bin fills bins of its own with its first pieces;
    the last piece is packed as other documents are, largest first.
    """
    bins = Bins(capacity, most_of_source)
    sources: dict[str | None, int] = {}
    clusters: dict[int, int] = {}
    rows, rest = [], []
    for doc, size, source, cluster in items:
        whole, last = divmod(size, capacity)
        for piece in range(whole):
            number, offset = bins.add(capacity, 0, 0)
            rows.append((doc, piece, piece * capacity, capacity, number, offset))
        if last:
            rest.append((last, doc, whole, source, cluster))
    rest.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0, x[4], x[3] or ""))
    for size, doc, piece, source, cluster in rest:
        number, offset = bins.add(size, sources.setdefault(source, len(sources)), clusters.setdefault(cluster, len(clusters)))
        rows.append((doc, piece, piece * capacity, size, number, offset))
    return rows


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sizes, clusters = [], []
        for text in texts_of(batch.column("text")):
            words = space_words(text)
            sizes.append(len(words) + 1)
            clusters.append(xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64()), pa.array(clusters, pa.int64())], names=["doc_id", "source", "size", "cluster"]
        )


def _packed(table: pa.Table, capacity: int, most_of_source: int) -> pa.Table:
    shard = table.column("shard")[0].as_py()
    rows = pack(list(zip(*(table.column(k).to_pylist() for k in ("doc_id", "size", "source", "cluster")), strict=True)), capacity, most_of_source)
    columns = list(zip(*rows, strict=True))
    columns[4] = [(shard << 32) + b for b in columns[4]]
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
    return pa.table({f.split()[0]: pa.array(c, k) for f, c, k in zip(SCHEMA.split(", "), columns, kinds, strict=True)})


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, most_of_source: int = MOST_OF_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    r"""A row ``doc_id, piece, start, n_tokens, bin_id, bin_offset`` for each piece of each document.

    A document has its words ``[^\x20\x09-\x0D]+`` and one end token; ``start`` is
    the piece's first token within the document, ``bin_offset`` its place in the
    bin.  Documents with the same words (A-Z in lower case) are one cluster.
    No bin holds more than ``capacity`` tokens, two last pieces of one cluster,
    or more than ``most_of_source`` last pieces of one source.

    Documents are packed in shards of about ``shard_rows``, by a hash of id and
    text; bins do not cross shards.  Null and empty texts take their end token;
    a null source is a source of its own; null ids and repeated rows are packed
    row by row.  Needs the columns ``doc_id``, ``text`` and ``source``; others are
    not read.  An empty table has no bins.
    """
    shards = max(1, -(-docs.count() // shard_rows))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    sized = narrow.mapInArrow(_sizes, "doc_id long, source string, size long, cluster long")
    dealt = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster"), F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInArrow(lambda t: _packed(t, capacity, most_of_source), SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    return best_fit_packing(spark.read.parquet(f"{sf_dir}/documents.parquet"))
