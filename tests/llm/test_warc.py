import base64
import gzip
import hashlib
import uuid

import pytest
from pyspark.sql import functions as F

from ferrule.llm import warc

PAGES = "page_id long, url string, html string, digest string, payload string, last long"


def brute(rows, least=0):
    low = lambda i: (i is not None, i or 0)
    held = {}
    for i, _, html in rows:
        held.setdefault(html or "", []).append(i)
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        last = max(held[html or ""], key=low)
        revisit = len(body) >= least and last is not None and i != last
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=repr)


@pytest.fixture
def folder(tmp_path):
    return lambda: f"file://{tmp_path}/{uuid.uuid4().hex}"


def archive(spark, rows, at, **options):
    df = spark.createDataFrame([(*r, "x", "y", 5) for r in rows], PAGES).repartition(3)
    warc.archive_pages(df, at, **options)
    return warc.read_archive(spark, at)


def got(df):
    return sorted(map(tuple, warc.page_index(df).collect()), key=repr)


ROWS = [
    (1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (9, "http://a/9", "<p>same</p>"), (None, "http://a/n", "<p>same</p>"),
    (3, None, None), (4, "http://b/\r\nX-Page-ID: 77\r\n", ""), (None, "http://c", "no id"), (None, "http://c", "no id"), (5, "http://d", "ÄÖ 中文 🌉\r\n\r\nWARC/1.1\r\n"), (-7, "http://e", "x" * 2_000_000), (2**62, "", "x" * 2_000_000),
]


def test_pages(spark, folder):
    for least in (0, 8, 12):
        df = archive(spark, ROWS, folder(), least_bytes=least)
        assert got(df) == brute(ROWS, least)
    assert df.select("digest").distinct().count() == len({h or "" for _, _, h in ROWS}) == spark.read.parquet(df.inputFiles()[0].rpartition("/")[0].replace("headers", "payloads")).count()


def test_empty(spark, folder):
    assert got(archive(spark, [], folder())) == []


def test_files(spark, folder, tmp_path):
    """Records as files hold, byte by byte, what the archive has; read again they make the same archive."""
    df = archive(spark, ROWS, folder())
    out = folder()
    warc.write_files(df, out, records_per_file=3)
    again = warc.read_files(spark, out)
    pairs = sorted((bytes(r["header"]), bytes(r["payload"])) for r in again.collect())
    assert pairs == sorted((bytes(r["header"]), bytes(r["payload"]) if r["inline"] else b"") for r in df.collect())
    second = folder()
    warc.store(again, second, header=F.col("header"), inline=F.lit(True))
    whole = sorted(bytes(r["record"]) for r in warc.records(warc.read_archive(spark, second)).collect())
    assert whole == sorted(h + p for h, p in pairs)
    heads = [h.split(b"\r\n\r\n")[0].split(b"\r\n") for h, _ in pairs]
    assert all(h[0] == b"WARC/1.1" and len({x.split(b":")[0] for x in h}) == len(h) for h in heads)


def test_compressed():
    a = b"WARC/1.0\r\nWARC-Type: metadata\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    b = b"WARC/1.0\r\nContent-Type: application/http;msgtype=response\r\ncontent-length: 18\r\n\r\nHTTP/1.1 200\r\n\r\nhi\r\n\r\n"
    expected = [(a[:-8], b"abcd"), (b[:-6], b"hi")]
    assert list(warc.split_records(a + b)) == list(warc.split_records(gzip.compress(a) + gzip.compress(b))) == expected
    with pytest.raises(ValueError, match="no end"):
        list(warc.split_records(a[:-1] + b))


def test_damage(spark, folder):
    """A payload that has changed on disk is not read as if nothing were."""
    at, second = folder(), folder()
    archive(spark, ROWS, at)
    spark.read.parquet(f"{at}/payloads").withColumn("payload", F.when(F.octet_length("payload") == 5, F.lit(b"other")).otherwise(F.col("payload"))).write.parquet(f"{second}/payloads")
    spark.read.parquet(f"{at}/headers").write.parquet(f"{second}/headers")
    with pytest.raises(Exception, match="a payload is not what it was"):
        warc.read_archive(spark, second).collect()


def test_digests(spark):
    texts = ["", "a", "payload", "ÿ" * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(warc.base32(F.sha1("t"))).collect()] == [base64.b32encode(hashlib.sha1(t.encode()).digest()).decode() for t in texts]
