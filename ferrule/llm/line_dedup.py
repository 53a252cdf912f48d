"""Line dedup: drop lines that many documents share, but for one copy.

Lines are exploded to hashes of their normalised form, the documents of each
hash are counted with map-side combining, and texts are put together again by
line position from what is left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import LOWER, code_points, slices, texts_of

LEAST_CHARS = 40
LEAST_DOCS = 5
#: Tasks that share the documents of one common line.
SALTS = 16
#: Stands for a null id: smaller than every other.
NO_ID = -(1 << 63)


def _key(line: bytes, least: int) -> bytes | None:
    r"""The digest of a line's key, or None if the key is short: stripped of ``[\x20\x09-\x0D]``, A-Z in lower case."""
    line = line.strip()
    if len(line) < least or (code_points(line) < least):
        return None
    return xxhash.xxh3_128_digest(line.translate(LOWER))


def _keys(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        ids, out_ids, out_keys = batch.column("_id").to_pylist(), [], []
        for doc, text in zip(ids, texts_of(batch.column("text")), strict=True):
            keys = {k for line in text.split(b"\n") if (k := _key(line, least))}
            out_ids += [doc] * len(keys)
            out_keys += keys
        yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out_keys, pa.binary())], names=["_id", "_key"])


def _cut(batches: Iterator[pa.RecordBatch], least: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = []
        for text, drop in zip(texts_of(batch.column("text")), batch.column("_drop").to_pylist(), strict=True):
            lines = text.split(b"\n")
            gone = set(drop or ())
            kept = [x for x in lines if _key(x, least) not in gone] if gone else lines
            rows.append((len(lines), len(lines) - len(kept), b"\n".join(kept)))
        counts = [pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)]
        digest = pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())
        text = pa.array([r[2] for r in rows] if with_text else [None] * len(rows), pa.binary()).cast(pa.string())
        rest = [batch.column(k) for k in batch.schema.names if k not in ("text", "_drop")]
        names = [k for k in batch.schema.names if k not in ("text", "_drop")]
        yield pa.RecordBatch.from_arrays([*rest, *counts, digest, text], names=[*names, "n_lines", "n_dropped", "kept_sha256", "kept_text"])


def _dropped(narrow: DataFrame, least_chars: int, least_docs: int) -> DataFrame:
    """``_id, _drop``: the keys whose lines a document loses; ``narrow`` has ``_id, text``."""
    keys = narrow.select("_id", "text").mapInArrow(lambda b: _keys(b, least_chars), "_id long, _key binary")
    # a document sends a key once, and distinct() folds rows that repeat an id
    common = keys.distinct().groupBy("_key").agg(F.max("_id").alias("_last"), F.count("*").alias("_n")).where(F.col("_n") >= least_docs)
    # a line may be in a third of all documents: its rows meet copies of its one row of ``common`` in several tasks
    spread = common.select("_key", "_last", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = keys.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int"))
    return salted.join(spread, ["_key", "_salt"]).where("_id < _last").groupBy("_id").agg(F.collect_set("_key").alias("_drop"))


def line_dedup(docs: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS, with_text: bool = True) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept_sha256, kept_text`` for each row of ``docs`` (``doc_id``, ``text``).

    Keys of at least ``least_chars`` code points in at least ``least_docs``
    documents lose all their lines except in the largest ``doc_id`` holding them.

    A null or empty text is one empty line.  Rows that repeat a ``doc_id`` count
    as one document and are cut alike; null ids count together as one document
    smaller than any other, as does an id of ``NO_ID`` itself.  Other columns are
    not read.  An empty table gives an empty table.  A text is split in one
    piece, whatever its length.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_id", F.coalesce("doc_id", F.lit(NO_ID)))
    drop = _dropped(narrow, least_chars, least_docs)
    kept = "doc_id long, n_lines long, n_dropped long, kept_sha256 string, kept_text string"
    return narrow.join(drop, "_id", "left").select("doc_id", "text", "_drop").mapInArrow(lambda b: _cut(b, least_chars, with_text), kept)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs``, with all its columns, less the lines that ``line_dedup`` drops.

    ``n_chars``, if there is such a column, follows the new text; a null text
    becomes the empty one.
    """
    rest = [c for c in docs.columns if c != "text"]
    narrow = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_rest"), "text")
    joined = narrow.join(_dropped(narrow, LEAST_CHARS, LEAST_DOCS), "_id", "left").select("_rest", "text", "_drop")
    kept = joined.mapInArrow(lambda b: _cut(b, LEAST_CHARS, True), f"_rest {narrow.schema['_rest'].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string, kept_text string")
    columns = {c: F.col("_rest")[c] for c in rest} | {"text": F.col("kept_text")}
    if "n_chars" in rest:
        columns["n_chars"] = F.length("kept_text").cast(docs.schema["n_chars"].dataType)
    return kept.select(*(columns[c].alias(c) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    return line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("kept_text")


SQL = """
WITH lines AS (
  SELECT doc_id, i, list_extract(ls, i) AS line,
         translate(trim(list_extract(ls, i), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), UNNEST(range(1, len(ls) + 1)) AS u(i)),
common AS (
  SELECT k, max(doc_id) AS last FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM (SELECT l.*, c.k IS NOT NULL AND l.doc_id < c.last AS gone FROM lines l LEFT JOIN common c ON l.k = c.k)
GROUP BY doc_id
"""
