"""Vectors of a collection with what they carry of their chunks; chunks that several files share."""

import __spark_entry__ as entry
from ferrule.plans import search as plans


def test_vectors_carry_their_chunk(spark):
    pages = [(f"{folder}/x.pdf", 1, f"Text of {folder}.", "text") for folder in "cab"] + [("y.pdf", 1, "Question No. ACME/1/2\nWhat?", "text")]
    c = plans.ingest(spark.createDataFrame(pages, "file string, page_num int, text string, page_kind string"))
    key = ("chunk_id", *plans.PAYLOAD)
    rows = {tuple(r) for r in c.vectors.select(*key).collect()}
    assert rows == {tuple(r) for r in c.chunks.select(*key).collect()}
    # one chunk of three files: the place of the first, the content of the last
    shared = c.chunks.where("page = 1 AND chunk_id LIKE 'x:%'").collect()
    assert [(r["ord"]["file"], r["file"], r["text"]) for r in shared] == [("a/x.pdf", "c/x.pdf", "Text of c.")]


def test_ingest_sorts_no_chunks_to_join_them(spark, sf):
    plan = entry.queries()["plan_ingest"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Sort" not in plan
