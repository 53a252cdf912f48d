r"""Content-addressed WARC archives: payloads once, exact record headers beside them.

An archive is a folder of two tables.  ``payloads`` has every payload once, under
its SHA-256; ``headers`` has the exact head of every record (the WARC header, and
the HTTP header of a response) with the digest of its payload.  Records come back
by a join; every payload is hashed again when it is read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_folder

#: Records of smaller payloads are all responses.
LEAST_BYTES = 0
#: The date of records; pages have none of their own.
DATE = "1970-01-01T00:00:00Z"
_CRLF = "\r\n"


def base32(sha1: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: eight digits for each five bytes."""
    # fixed values: the digits of radix 32 as conv() writes them, and those of base32
    blocks = [F.lpad(F.conv(F.substring(sha1, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*blocks), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _uuid(name: Column) -> Column:
    h = F.md5(name)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def _lines(*fields: tuple[str, Column]) -> Column:
    """``Name: value`` lines; a null value leaves out its line."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_CRLF)), F.lit("")) for name, value in fields))


def store(records: DataFrame, folder: str, header: Column, inline: Column, id_column: str | None = None) -> None:
    """Write the archive of ``records`` to ``folder``: payloads once, then headers.

    ``records`` has a binary ``payload``.  ``header`` and ``inline`` (whether the payload
    stands in the record itself) may use its other columns and, of each payload,
    ``digest``, ``sha1`` (in base32), ``n_bytes`` and ``last`` (the largest ``id_column``).
    """
    spark = records.sparkSession
    keyed = records.withColumn("digest", F.sha2("payload", 256))
    last = F.max(id_column) if id_column else F.lit(None).cast("long")
    sha1 = F.sha1("payload")
    once = keyed.groupBy("digest").agg(F.first("payload").alias("payload"), last.alias("last"), F.min(sha1).alias("_a"), F.max(sha1).alias("_b"), F.min(F.octet_length("payload")).cast("long").alias("n_bytes"), F.max(F.octet_length("payload")).cast("long").alias("_n"))
    checked = F.when((F.col("_a") == F.col("_b")) & (F.col("n_bytes") == F.col("_n")), base32(F.col("_a"))).otherwise(F.raise_error(F.lit("two payloads have one digest")))
    once.select("digest", checked.alias("sha1"), "n_bytes", "last", "payload").write.parquet(f"{folder}/payloads")
    known = spark.read.parquet(f"{folder}/payloads").drop("payload")
    keyed.drop("payload").join(known, "digest").select("digest", header.cast("binary").alias("header"), inline.alias("inline")).write.parquet(f"{folder}/headers")


def archive_pages(pages: DataFrame, folder: str, least_bytes: int = LEAST_BYTES, date: str = DATE) -> None:
    """Write a record for each row of ``pages`` (``page_id``, ``url``, ``html``) to an archive in ``folder``, which must be new.

    Of records with equal payloads of at least ``least_bytes`` bytes that with the
    largest ``page_id`` is a response and the others revisit it; smaller ones are
    all responses.

    A null html is an empty payload, a null url leaves out its header line.  A null
    id is smaller than any other; pages of one payload without any id are all
    responses, and so are rows that repeat the id of the response.  Line breaks in a
    url are written as %0D and %0A.  Other columns are not read; an empty table
    makes an empty archive.  A payload is hashed in one piece, whatever its length.
    """
    revisit = (F.col("n_bytes") >= least_bytes) & F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    name = lambda page: _uuid(F.concat_ws(":", page, "digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(_CRLF * 2))
    fields = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Record-ID", name("page_id")),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        ("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        ("WARC-Refers-To", F.when(revisit, name("last"))),
        ("X-Page-ID", F.col("page_id")),
        ("X-Refers-To-Page-ID", F.when(revisit, F.col("last"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))),
    ]
    header = F.concat(F.lit("WARC/1.1" + _CRLF), _lines(*fields), F.lit(_CRLF), http)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    store(rows, folder, header, ~revisit, "page_id")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """``header, payload, inline, digest`` of each record of an archive; a payload that does not have its digest is an error."""
    payloads = spark.read.parquet(f"{folder}/payloads").select("digest", "payload")
    whole = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("a payload is not what it was: "), "digest")))
    return spark.read.parquet(f"{folder}/headers").join(payloads.select("digest", whole.alias("payload")), "digest")


def records(archive: DataFrame) -> DataFrame:
    """``record``: the exact bytes of each record, up to the two line breaks that end it."""
    return archive.select(F.concat("header", F.when(F.col("inline"), F.col("payload")).otherwise(F.lit(b""))).alias("record"))


def write_files(archive: DataFrame, path: str, records_per_file: int = 10_000) -> None:
    """The records as WARC files, uncompressed."""
    lines = records(archive).select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", _CRLF * 2).option("maxRecordsPerFile", records_per_file).text(path)


def _inflated(data: bytes) -> bytes:
    """A file's bytes; of a compressed one, those of all its members."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join([*out, data])


def split_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Head and payload of each record of a WARC file; of HTTP responses the payload is what follows their header."""
    data, at = _inflated(data), 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at) + 4
        fields = dict(x.split(b":", 1) for x in data[at:end].split(b"\r\n")[1:] if b":" in x)
        fields = {k.strip().lower(): v.strip() for k, v in fields.items()}
        stop = end + int(fields[b"content-length"])
        if fields.get(b"content-type", b"").replace(b" ", b"").startswith(b"application/http;msgtype=response"):
            found = data.find(b"\r\n\r\n", end, stop)
            end = stop if found < 0 else found + 4
        yield data[at:end], data[end:stop]
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"no end of a record at byte {stop}")
        at = stop + 4


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("content"):
            pairs = list(split_records(data.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in pairs], pa.binary()) for k in (0, 1)], names=["header", "payload"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``header, payload`` of each record of WARC files, compressed or not; a file is split in one task.

    ``store(read_files(...), folder, header=F.col("header"), inline=F.lit(True))`` archives them.
    """
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_split, "header binary, payload binary")


def page_index(archive: DataFrame) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of each record that ``archive_pages`` wrote."""
    head = F.decode("header", "utf-8")
    field = lambda name: F.nullif(F.regexp_extract(head, rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))
    own = base32(F.sha1("payload"))
    digest = F.when(field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), own), own).otherwise(F.raise_error(F.lit("a record's payload is not that of its header")))
    return archive.select(
        field("X-Page-ID").cast("long").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"),
        field("WARC-Type").alias("record_type"), field("X-Refers-To-Page-ID").cast("long").alias("refers_to"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return page_index(read_archive(spark, folder))


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha1(body) AS h, max(page_id) OVER (PARTITION BY sha256(body)) AS last FROM p),
parts AS (
  SELECT page_id, k, j, CAST('0x' || substr(h, 10 * k + 1, 10) AS BIGINT) AS v
  FROM d, UNNEST(range(4)) AS a(k), UNNEST(range(8)) AS b(j)),
digits AS (
  SELECT page_id, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((v >> CAST(35 - 5 * j AS BIGINT)) & 31 AS INTEGER) + 1, 1), '' ORDER BY k, j) AS digest
  FROM parts GROUP BY page_id)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM d JOIN digits USING (page_id)
"""
