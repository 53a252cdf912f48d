"""Files of pages as a data source: ranges, filters, and what cannot be read."""

import pytest
from pyspark.sql import functions as F

from ferrule.plans import search as plans
from ferrule.plans.slots import Slots
from ferrule.sources.page_files import FilteringReader, PageFiles, read_page_files


def pgm(w, h, value, comment=b""):
    return b"P5\n" + comment + b"%d %d\n255\n" % (w, h) + bytes([value]) * (w * h)


IMAGES = [pgm(3, 2, 1), pgm(500, 40, 2, b"# 9 9 a note\n"), b"P6 2 2 255\n" + bytes(range(12)), pgm(1, 1, 12)]
TEXTS = {"b.txt": ["first " * 50, "", "dritte ä " * 70, "last"], "a.txt": [f"page {i} " * (i % 7) for i in range(1, 40)], "empty.txt": [""]}


@pytest.fixture
def folder(tmp_path):
    for name, pages in TEXTS.items():
        (tmp_path / name).write_bytes("\f".join(pages).encode())
    (tmp_path / "scan.pgm").write_bytes(b"".join(IMAGES))
    (tmp_path / "bad.txt").write_bytes(b"good\f\xff\xfe bad\fgood again")
    return str(tmp_path)


EXPECTED = sorted([(n, i, t) for n, ts in TEXTS.items() for i, t in enumerate(ts, 1)] + [("bad.txt", 1, "good"), ("bad.txt", 2, ""), ("bad.txt", 3, "good again")] + [("scan.pgm", i, "") for i in range(1, 5)])


@pytest.mark.parametrize("task_bytes", [1 << 26, 1000, 64, 7])
def test_ranges(spark, folder, task_bytes):
    """However finely files are dealt, each page is read once and whole."""
    df = read_page_files(spark, folder, task_bytes=task_bytes)
    rows = df.collect()
    assert sorted((r["file"], r["page_num"], r["text"]) for r in rows) == EXPECTED
    assert [bytes(r["image"]) for r in sorted(rows, key=lambda r: r["page_num"]) if r["file"] == "scan.pgm"] == IMAGES
    assert df.rdd.getNumPartitions() >= 5


def test_names(spark, folder):
    assert {r["file"] for r in read_page_files(spark, folder + "/*.txt").collect()} == {"a.txt", "b.txt", "bad.txt", "empty.txt"}
    assert read_page_files(spark, folder + "/b.txt").count() == 4 and read_page_files(spark, "file://" + folder + "/a.*").count() == 39
    with pytest.raises(Exception, match="FileNotFound"):
        read_page_files(spark, folder + "/none").count()


def test_filters_reach_the_reader(spark, folder, capsys):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = read_page_files(spark, folder, max_pages=20, task_bytes=100)
        some = df.where((F.col("page_num") > 2) & (F.col("page_num") <= 4) & F.col("file").isin("a.txt", "b.txt") & (F.length("text") > 5))
        assert sorted((r["file"], r["page_num"]) for r in some.collect()) == [("a.txt", 3), ("a.txt", 4), ("b.txt", 3)]
        some.explain()
        filters = [x for x in capsys.readouterr().out.splitlines() if "Filter" in x]
        assert "length" in filters[0] and "<= 4" not in filters[0] and "IN (" not in filters[0]  # what is left to Spark
        assert df.where("page_num > 20").count() == 0 and df.groupBy("file").count().where("file = 'a.txt'").first()["count"] == 20
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_pushed(folder):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan, StringContains

    reader = PageFiles({"path": folder, "max_pages": "9", "push": "true"}).reader(None)
    assert isinstance(reader, FilteringReader)
    left = [*reader.pushFilters([GreaterThanOrEqual(("page_num",), 2), LessThan(("page_num",), 5), In(("file",), ("a.txt", "b.txt")), EqualTo(("file",), "b.txt"), StringContains(("text",), "x")])]
    assert [type(f) for f in left] == [StringContains]
    assert (reader.wanted.first, reader.wanted.last, reader.wanted.files) == (2, 4, {"b.txt"})
    assert [p.path.rpartition("/")[2] for p in reader.partitions()] == ["b.txt"]  # other files are not opened


def test_broken_images(spark, tmp_path):
    (tmp_path / "cut.pgm").write_bytes(IMAGES[0] + IMAGES[1][:-5])
    assert [r["image"] is None for r in read_page_files(spark, str(tmp_path)).orderBy("page_num").collect()] == [False, True]
    (tmp_path / "none.pgm").write_bytes(b"no image at all\n")
    with pytest.raises(Exception, match="page 1 is no binary netpbm image"):
        read_page_files(spark, str(tmp_path)).count()


def test_ingest_by_the_parse_slot(spark, folder):
    c = plans.ingest_path(spark, folder + "/b.txt")
    assert {r["file"] for r in c.chunks.collect()} == {"b.txt"}
    seen = []

    def parse(session, path):
        seen.append(path)
        return read_page_files(session, path, max_pages=1)

    assert plans.ingest_path(spark, folder + "/b.txt", slots=Slots(parse=parse)).chunks.select("page").distinct().count() == 1 and seen == [folder + "/b.txt"]
