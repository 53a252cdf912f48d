"""Readings by gates: what is read dearly is what needs it, and nothing else."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from ferrule.plans import search as plans
from ferrule.plans.scanning import CACHE, Reader, as_pages, read_pages
from ferrule.plans.slots import Slots

READER = Reader("local", "m", "contract")


class Engine:
    """Images are ``name@turn@dpi``; ``known`` tells what is read from them. Counts what it is asked for."""

    def __init__(self, spark, known):
        sc = spark.sparkContext
        self.known, self.reads, self.renders, self.turns = known, sc.accumulator(0), sc.accumulator(0), sc.accumulator(0)

    def slots(self, **more):
        known, reads, renders, turns = self.known, self.reads, self.renders, self.turns

        def ocr(image: pd.Series) -> pd.DataFrame:
            reads.add(len(image))
            return pd.DataFrame([known.get(bytes(x).decode(), ("junk", [0.2])) or (None, None) for x in image], columns=["text", "scores"])

        def turn(image: pd.Series, degrees: pd.Series) -> pd.Series:
            turns.add(int((degrees != 0).sum()))
            return pd.Series([bytes(x).decode().replace("@0@", f"@{0 if d != d else int(d)}@").encode() for x, d in zip(image, degrees, strict=True)])

        def fine(file: pd.Series, page: pd.Series) -> pd.Series:
            renders.add(len(file))
            return pd.Series([f"{f}{p}@0@300".encode() for f, p in zip(file, page, strict=True)])

        ocr = F.pandas_udf(ocr, "text string, scores array<double>").asNondeterministic()
        fine = F.pandas_udf(fine, "binary").asNondeterministic()
        return Slots(ocr=ocr, turn=F.pandas_udf(turn, "binary").asNondeterministic(), render=lambda file, page, dpi: fine(file, page), **more)


KNOWN = {
    "a1@0@150": ("good text", [0.9, 0.8]),  # passes at once
    "a2@90@150": ("a sideways text", [0.9]),  # reads in another turn
    "a3@0@150": ("small", [0.5]), "a3@0@300": ("small print that can be read", [0.9]),
    "a4@0@150": ("faint", [0.7]), "a4@0@300": ("f", [0.7]),  # the finer reading has less in it
    "a5@0@150": None,  # the engine fails
    "a6@0@150": ("", []), "a6@90@150": ("", []), "a6@180@150": ("", []), "a6@270@150": ("", []), "a6@0@300": ("", []),
    "a8@0@150": ("never read", [0.9]),
}


def images(spark, names):
    return spark.createDataFrame([("a", i, None if n is None else bytearray(f"{n}@0@150".encode())) for i, n in names], "file string, page int, image binary").repartition(3)


PAGES = [(1, "a1"), (2, "a2"), (3, "a3"), (4, "a4"), (5, "a5"), (6, "a6"), (7, None), (8, "a8"), (9, "a1"), (10, "a1")]


def rows(df):
    return {r["page"]: (r["text"], r["rotation"], r["refined"], r["source"]) for r in df.collect()}


def test_gates(spark):
    engine = Engine(spark, KNOWN)
    pages = images(spark, PAGES)
    key = F.concat(F.sha2("image", 256), F.lit(READER.suffix()))
    cache = pages.where("page = 8").select(key.alias("key"), F.lit("from the cache").alias("text"), F.array(F.lit(0.1)).alias("scores"), F.lit(0).alias("rotation"), F.lit(False).alias("refined"))
    out, new = read_pages(pages, READER, engine.slots(), cache)
    assert rows(out) == {
        1: ("good text", 0, False, "plain"), 9: ("good text", 0, False, "plain"), 10: ("good text", 0, False, "plain"), 2: ("a sideways text", 90, False, "probed"), 3: ("small print that can be read", 0, True, "probed"),
        4: ("faint", 0, False, "probed"), 5: (None, 0, False, "empty"), 6: ("", 0, False, "probed"), 7: (None, 0, False, "empty"), 8: ("from the cache", 0, False, "cache"),
    }
    # six contents read plainly (a1 once, a8 never); three turns of a2, a3, a4 and a6; a3, a4 and a6 rendered anew
    assert engine.renders.value == 3 and engine.reads.value == 6 + 4 * 3 + 3
    assert engine.turns.value == 4 * 3
    assert sorted(r["text"] for r in new.collect()) == ["a sideways text", "faint", "good text", "small print that can be read"]
    assert new.columns == [c.split()[0] for c in CACHE.split(", ")]

    # with what is new in the cache only the empty page and the failed one are tried again
    again = Engine(spark, KNOWN)
    rows_again = rows(read_pages(pages, READER, again.slots(), cache.unionByName(new))[0])
    assert {k: v[:3] for k, v in rows_again.items()} == {k: v[:3] for k, v in rows(out).items()}
    assert again.reads.value == 2 + 3 + 1 and again.renders.value == 1


def test_options(spark):
    engine = Engine(spark, KNOWN)
    pages = images(spark, PAGES)
    out, _ = read_pages(pages, Reader("local", max_pages=3, rotate=False, rescue=False), engine.slots())
    assert rows(out) == {1: ("good text", 0, False, "plain"), 2: ("junk", 0, False, "plain"), 3: ("small", 0, False, "plain")}
    assert (engine.reads.value, engine.renders.value, engine.turns.value) == (3, 0, 0)
    assert len({Reader(*x).suffix() for x in (("a",), ("b",), ("a", "m"), ("a", "", "m"))}) == 4  # readings of different make are kept apart
    assert read_pages(pages.limit(0), READER, engine.slots())[0].count() == 0
    with pytest.raises(ValueError, match="listed twice"):
        read_pages(pages.unionByName(pages), READER, engine.slots())
    with pytest.raises(ValueError, match="engine"):
        read_pages(pages, READER, Slots())


def test_readings_are_ingested(spark):
    out, _ = read_pages(images(spark, PAGES[:3]), READER, Engine(spark, KNOWN).slots())
    c = plans.ingest(as_pages(out))
    assert "sideways" in " ".join(r["text"] for r in c.chunks.collect())


def test_captions_within_ingest(spark):
    """Drawn pages are captioned upright and once an image, through the cache, before they are indexed."""
    pages = spark.createDataFrame(
        [("a", 1, "Drawing No. AB/12 of the roof", "drawing", 90), ("a", 2, "Drawing No. AB/13 of the gate", "drawing", 0), ("a", 3, "The roof is of steel. It is high.", "text", 0), ("a", 4, "Drawing No. AB/14", "drawing", 0), ("a", 5, "Drawing No. AB/15", "drawing", 0)],
        "file string, page_num int, text string, page_kind string, rotation int",
    ).withColumn("tables", F.array().cast("array<string>"))
    images = spark.createDataFrame([("a", i, bytearray(f"{n}@0@150".encode())) for i, n in ((1, "roof"), (2, "gate"), (4, "gate"))], "file string, page int, image binary")
    calls = spark.sparkContext.accumulator(0)

    def caption(image: pd.Series, nearby: pd.Series) -> pd.Series:
        calls.add(int(image.notna().sum()))
        return pd.Series(["" if x is None else f"picture {bytes(x).decode()}" for x in image])

    slots = Engine(spark, {}).slots(caption=F.pandas_udf(caption, "string").asNondeterministic())
    c = plans.ingest(pages, slots=slots, images=images, model="m", profile="contract")
    got = {r["page"]: r["caption"] for r in c.chunks.where("chunk_type = 'drawing'").collect()}
    assert got == {1: "picture roof@90@150", 2: "picture gate@0@150", 4: "picture gate@0@150", 5: ""}
    assert c.new_captions.count() == 2 and calls.value == 2
    assert plans.search(c, spark.createDataFrame([(1, "picture gate")], "query_id int, text string")).where("rank <= 2").select("page").distinct().count() == 2
    cached = spark.createDataFrame(c.new_captions.collect(), "key string, payload binary")
    again = plans.ingest(pages, slots=slots, images=images, captions=cached, model="m", profile="contract")
    assert {r["page"]: r["caption"] for r in again.chunks.where("chunk_type = 'drawing'").collect()} == got and calls.value == 2
    plans.ingest(pages, slots=slots, images=images, captions=cached, model="other", profile="contract")
    assert calls.value == 4


def test_search_warns_of_a_lost_index(spark):
    c = plans.ingest(as_pages(spark.createDataFrame([("a", 1, "The roof is of steel. It is high.", 0)], "file string, page int, text string, rotation int")))
    asked = spark.createDataFrame([(1, "roof")], "query_id int, text string")
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        plans.check_index(c)
    lost = plans.Collection(c.chunks, c.vectors, plans.bm25.build(c.chunks.limit(0).select("chunk_id", "ord", "text")), c.edges)
    with pytest.warns(UserWarning, match="by vectors alone"):
        assert plans.search(lost, asked).count() == 1


def test_redaction_is_refused(spark):
    from ferrule.operators import redaction

    docs = spark.createDataFrame([(1, "Acme builds"), (2, "see <ORG_1> of Acme"), (3, "see <ORG_9>")], "doc_id int, text string")
    spans = redaction.entities(docs, redaction.Dictionary({"ORG": ("Acme",)}))
    with pytest.raises(ValueError, match="text 2 already holds the placeholder <ORG_1>"):
        redaction.redact(docs, spans, redaction.mapping(spans))
    fine = docs.where("doc_id <> 2")
    spans = redaction.entities(fine, redaction.Dictionary({"ORG": ("Acme",)}))
    assert {r["redacted_text"] for r in redaction.redact(fine, spans, redaction.mapping(spans)).collect()} == {"<ORG_1> builds", "see <ORG_9>"}
