"""Page images, batches under one budget, captions through a cache, classifier versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrule.operators import batch, evaluation, images, quality
from ferrule.plans import search as plans
from ferrule.plans.slots import Slots, attach_captions, base_url, cached_captions
from ferrule.sources import scratch


def pgm(levels):
    levels = np.asarray(levels, np.uint8)
    return b"P5\n# a comment\n%d %d\n255\n" % (levels.shape[1], levels.shape[0]) + levels.tobytes()


def test_jpeg_extent():
    head = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xff\xc2\x00\x0b\x08\x01\x02\x03\x04" + b"\x00" * 8
    assert images.jpeg_extent(head) == (0x304, 0x102)
    for bad in (b"", b"\xff\xd8", b"GIF89a", head[:9]):
        assert images.jpeg_extent(bad) is None


def test_ink():
    page = np.full((100, 80), 255)
    page[:25] = 0
    dark, strong = images.ink(pgm(page))
    assert dark == 0.25 and 0 < strong < 0.08  # one edge across the page
    striped = np.full((90, 80), 255)
    striped[::3] = 100
    assert images.ink(pgm(striped))[0] == pytest.approx(1 / 3)
    assert images.ink(b"no image") is None
    wide = np.full((10, 2000), 255)
    wide[:, :1000] = 0
    assert images.shrunk(images.gray(pgm(wide))).shape == (3, 512) and images.ink(pgm(wide))[0] == pytest.approx(0.5, abs=0.01)


def test_turns():
    page = pgm([[1, 2, 3], [4, 5, 6]])
    assert images.turned(page, 0) is page and images.turned(page, 360) is page
    assert images.gray(images.turned(page, 90)).tolist() == [[3, 6], [2, 5], [1, 4]]
    assert images.gray(images.turned(images.turned(page, 90), 270)).tolist() == images.gray(page).tolist()
    assert images.turned(b"x", 90) is None
    with pytest.raises(ValueError):
        images.turned(page, 45)


def test_image_columns(spark):
    df = spark.createDataFrame([(1, bytearray(pgm([[0, 255]])), 90), (2, None, None), (3, bytearray(b"x"), 0)], "i int, c binary, d int")
    out = df.select("i", images.signals(F.col("c")).alias("s"), images.extent(F.col("c")).alias("e"), images.turn(F.col("c"), F.col("d")).alias("t")).orderBy("i").collect()
    assert out[0]["s"]["dark"] == 0.5 and out[1]["s"]["dark"] is None and out[2]["s"]["dark"] is None
    assert images.gray(bytes(out[0]["t"])).tolist() == [[255], [0]] and out[1]["t"] is None and bytes(out[2]["t"]) == b"x"
    assert out[0]["e"]["width"] is None


def test_one_budget_for_the_run(spark):
    work = spark.createDataFrame([(f, i, 0.05) for f in "ab" for i in range(5)], "file string, page int, cost_usd double").repartition(3)
    started = sorted((r["file"], r["page"]) for r in batch.within_run_budget(work, 0.30).collect())
    assert started == [("a", i) for i in range(5)] + [("b", 0)]
    assert batch.within_run_budget(work, 0.0).count() == 0


def test_batch_resumes(spark):
    pages = spark.createDataFrame([("f", 1, "one"), ("f", 2, "bad"), ("f", 3, ""), ("f", 4, "one"), ("f", 5, "five")], "file string, page int, content string")
    none = spark.createDataFrame([], "key string, text string"), spark.createDataFrame([], "file string, page int, status string")

    def read(content):
        if content == b"bad":
            raise ValueError("torn")
        return content.decode()

    # blank and failed pages cost nothing: 4 starts at 0.1 spent, 5 would at 0.2
    with pytest.raises(batch.BudgetExceeded, match=r"\$0.2000 spent of a budget of \$0.1500") as over:
        batch.run_batch(pages, none[1], none[0], read, 0.1, 0.15)
    first = over.value.progress
    rows = {r["page"]: (r["status"], r["error_msg"], r["text"], r["cost_usd"]) for r in first.collect()}
    assert rows == {1: ("done", None, "one", 0.1), 2: ("error", "ValueError: torn", None, 0.0), 3: ("done", None, "", 0.0), 4: ("done", None, "one", 0.1)}
    with pytest.raises(RuntimeError, match="1 pages failed, first f p.2: ValueError: torn"):
        batch.check_errors(first)
    cache = first.where("status = 'done'").select("key", "text")
    again = pages.unionByName(spark.createDataFrame([("g", 1, "one"), ("g", 2, "six"), ("g", 2, "six")], pages.schema))
    second = batch.run_batch(again, first, cache, lambda c: c.decode(), 0.1, 10.0)
    assert sorted((r["file"], r["page"], r["status"], r["text"]) for r in second.collect()) == [("f", 2, "done", "bad"), ("f", 5, "done", "five"), ("g", 1, "skipped_cached", "one"), ("g", 2, "done", "six")]
    batch.check_errors(second)
    assert batch.summary(first.unionByName(second).withColumn("elapsed_s", F.lit(2.5))).first().asDict() == {"n_done": 6, "n_skipped": 1, "n_error": 1, "cost_usd": 0.5, "elapsed_s": 2.5}


def started(pages, cost, cap):
    """Which pages start one after the other until the cap is spent, by what they really cost."""
    spent, out = 0, []
    for page, c in pages:
        if spent >= round(cap * 1e6):
            break
        out.append(page)
        spent += round(c * 1e6)
    return out, spent / 1e6


@pytest.mark.parametrize(("cap", "failing"), [(0.25, {1, 2, 3, 4, 5}), (0.1, set()), (0.0, set()), (0.3, {2, 4, 6}), (5.0, {1})])
def test_budget_of_real_spending(spark, cap, failing):
    pages = spark.createDataFrame([("f", i, str(i)) for i in range(1, 11)], "file string, page int, content string").repartition(3)
    none = spark.createDataFrame([], "file string, page int, status string"), spark.createDataFrame([], "key string, text string")

    def read(content):
        if int(content) in failing:
            raise ValueError("torn")
        return content.decode(), 0.1 if int(content) % 2 else 0.05

    def run():
        return batch.run_batch(pages, *none, read, 0.1, cap)

    expected, spent = started([(i, 0.0 if i in failing else 0.1 if i % 2 else 0.05) for i in range(1, 11)], 0.1, cap)
    if len(expected) < 10:
        with pytest.raises(batch.BudgetExceeded) as over:
            run()
        assert (over.value.spent, over.value.cap) == (pytest.approx(spent), cap)
        progress = over.value.progress
    else:
        progress = run()
    assert sorted(r["page"] for r in progress.collect()) == expected
    if cap == 0.25:
        assert expected == [1, 2, 3, 4, 5, 6, 7, 8, 9]


def test_five_failing_pages(spark):
    pages = spark.createDataFrame([("f", i, str(i)) for i in range(1, 11)], "file string, page int, content string")

    def read(content):
        if int(content) <= 5:
            raise ValueError("torn")
        return content.decode()

    with pytest.raises(batch.BudgetExceeded) as over:
        batch.run_batch(pages, spark.createDataFrame([], "file string, page int, status string"), spark.createDataFrame([], "key string, text string"), read, 0.1, 0.25)
    assert sorted(r["page"] for r in over.value.progress.where("status = 'done'").collect()) == [6, 7, 8]
    assert over.value.spent == pytest.approx(0.3)


def test_second_phase_ingests_what_was_read(spark):
    pages = spark.createDataFrame([("f", 1, "scan"), ("f", 2, "scan")], "file string, page_num int, text string").withColumns({"tables": F.array().cast("array<string>"), "page_kind": F.lit("text"), "rotation": F.lit(0)})
    progress = spark.createDataFrame([("f", 1, "done", "The roof is of steel. It is high."), ("f", 2, "error", None)], "file string, page int, status string, text string")
    c = plans.ingest_read(pages, progress)
    assert {r["page"] for r in c.chunks.collect()} == {1} and "steel" in c.chunks.first()["text"]
    assert plans.counters(c.chunks).first()["n_pages"] == 1
    assert plans.degraded(0, 5) and not plans.degraded(0, 0) and not plans.degraded(3, 5)


def test_captions_through_a_cache(spark):
    wanted = spark.createDataFrame([("a", None, "x"), ("b", None, "x"), ("c", None, "x"), ("d", None, None)], "key string, image binary, nearby string")
    cache = spark.createDataFrame([("a", bytearray(b"")), ("b", bytearray(b"\xff\xfe"))], "key string, payload binary")
    out, new = cached_captions(wanted, cache, Slots(caption=lambda image, nearby: nearby))
    assert {r["key"]: r["caption"] for r in out.collect()} == {"a": "", "b": "x", "c": "x", "d": None}
    assert sorted(r["key"] for r in new.collect()) == ["b", "c"]


def test_captions_see_pages_upright(spark):
    chunks = spark.createDataFrame([("f", 1, "drawing", "t", None), ("f", 2, "drawing", "t", None)], "file string, page int, chunk_type string, text string, caption string")
    pages = spark.createDataFrame([("f", 1, bytearray(b"one")), ("f", 2, bytearray(b"two"))], "file string, page int, image binary")
    turns = spark.createDataFrame([("f", 2, 90)], "file string, page int, rotation int")
    slots = Slots(caption=lambda image, nearby: image.cast("string"), turn=lambda image, degrees: F.concat(image.cast("string"), degrees.cast("string")).cast("binary"))
    got = {r["page"]: r["caption"] for r in attach_captions(chunks, pages, slots, turns).collect()}
    assert got == {1: "one", 2: "two90"}


def test_versions():
    assert quality.classifier_version() == "v1" and quality.classifier_version(None, "v2") == "v2" and quality.classifier_version("v1", "v2") == "v1"
    with pytest.raises(ValueError, match="v3"):
        quality.classifier_version("v3")


def test_addresses():
    assert base_url("http://h:1/") == base_url("http://h:1") == base_url("http://h:1/v1") == base_url("http://h:1/v1//") == "http://h:1/v1"


def test_relevancy(spark):
    rows = spark.createDataFrame([("Is the roof steel", "the roof"), ("", "x"), ("a b", None)], "q string, a string").select(evaluation.question_share(F.col("q"), F.col("a")).alias("r")).collect()
    assert rows[0]["r"] == 0.5 and rows[1]["r"] is None


def test_shared_folder(spark):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:
            @staticmethod
            def get(*_):
                return None

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Cluster)
    assert scratch.shared_folder(spark) == scratch.shared_folder(spark)


def test_stretches_that_cost_nothing_need_few_waves(spark, monkeypatch):
    """A thousand pages fail before the first that is paid for: they are read in a few steps, each once, and not one page too many."""
    steps, made = [], batch.materialise
    monkeypatch.setattr(batch, "materialise", lambda df, name: steps.append(name) or made(df, name))
    monkeypatch.setattr(batch, "AHEAD", 300)
    pages = spark.createDataFrame([("a", i, str(i).encode()) for i in range(1300)], "file string, page int, content binary")

    def read(content):
        if int(content) < 1000 or int(content) % 3 == 0:
            raise ValueError
        return content.decode()

    none = spark.createDataFrame([], "file string, page int, status string"), spark.createDataFrame([], "key string, text string")
    with pytest.raises(batch.BudgetExceeded) as over:
        batch.run_batch(pages, *none, read, 0.1, 2.0)
    paid, last = 0, 1000
    while paid < 20:
        paid, last = paid + (last % 3 > 0), last + 1
    got = [(r["page"], r["status"]) for r in over.value.progress.collect()]
    assert sorted(got) == [(i, "error" if i < 1000 or i % 3 == 0 else "done") for i in range(last)]
    assert steps.count("progress") < 15
    assert over.value.spent == pytest.approx(2.0)
