"""Files in and out, profiles, streams, plans and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from ferrule import cli, config
from ferrule.plans import search as plans
from ferrule.plans.slots import Slots, attach_captions, row_udf
from ferrule.schema import CHUNK
from ferrule.sources import tables as sources
from ferrule.streaming import ingest as streams


def chunk(i, text="t", kind="paragraph", page=1, caption=None):
    return (f"c{i}", text, "f.pdf", page, kind, None, None, ["D1"], [], None, caption, (1.0, 2.0, 3.0, 4.0))


def test_chunk_snapshots(spark, tmp_path):
    path = str(tmp_path / "chunks")
    assert sources.read_chunks(spark, path).count() == 0
    df = spark.createDataFrame([chunk(1), chunk(2, caption="")], CHUNK)
    sources.append_chunks(df, path)
    sources.append_chunks(df.limit(1), path)
    got = sources.read_chunks(spark, path)
    assert got.count() == 3 and got.distinct().count() == 2 and {r["caption"] for r in got.collect()} == {None, ""}
    (tmp_path / "old.json").write_text(json.dumps({"id": "x", "text": "t", "file": "f", "page": 1, "chunk_type": "paragraph", "bbox": [1, 2, 3, 4]}) + "\n\n")
    assert sources.read_chunks(spark, str(tmp_path / "old.json")).first()["bbox"]["y1"] == 4.0


def test_cases_skip_comments(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('# note\n\n  {"id": "a", "question": "q", "expected_sources": [{"file": "f", "page_min": 1, "page_max": 2}], "expected_keywords": ["k"], "category": "x"}\n')
    rows = sources.read_cases(spark, str(tmp_path / "c.jsonl")).collect()
    assert len(rows) == 1 and rows[0]["expected_sources"][0]["page_max"] == 2


def test_signals_keep_order(spark, tmp_path):
    for name, pages in (("a", (3, 1)), ("b", (2,))):
        (tmp_path / name).write_text("\n".join(json.dumps({"page_num": p, "boxes": 1, "box_coverage": 0.1}) for p in pages) + "\n\n")
    rows = sources.read_signals(spark, str(tmp_path / "b"), str(tmp_path / "a")).orderBy("ord").collect()
    assert [r["page_num"] for r in rows] == [2, 3, 1]


def test_torn_checkpoints(spark, tmp_path):
    path = tmp_path / "p.jsonl"
    assert sources.read_checkpoint(spark, str(path)).count() == 0
    path.write_text('{"file": "a", "page": 1, "status": "done", "cost_usd": 0.1}\n{"file": "a", "pa')
    assert [tuple(r)[:3] for r in sources.read_checkpoint(spark, str(path)).collect()] == [("a", 1, "done")]


def test_provenance_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("h", "p", "1", "ocr", None, ""), ("h", "p", "0", "ocr", None, ""), ("h", "q", "2", "ocr", None, "")], "content_hash string, provider string, assigned_at string, task_kind string, redaction_applied boolean, notes string")
    path = str(tmp_path / "prov")
    assert [sources.append_provenance(rows, path) for _ in range(2)] == [2, 0]
    assert {r["assigned_at"] for r in spark.read.json(path).collect()} == {"0", "2"}


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\ftwo")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe bad")
    rows = sources.read_text_files(spark, str(tmp_path / "*.txt")).orderBy("file", "page_num").collect()
    assert [(r["page_num"], r["text"]) for r in rows] == [(1, "one"), (2, "two"), (1, "")]


def test_profiles(tmp_path):
    assert config.available_profiles() == ["contract", "document"] and config.load_profile("document").structure.question is None
    body = "name: own\nanswer_framing: f\nocr_text_prompt: a\nocr_drawing_prompt: b\ncaption_prompt: c\nstructure:\n  qa_block_pattern: '^Q(\\d+)'\n  ref_rules:\n  - {pattern: 'R(\\d)', target_field: clause_refs}\n"
    (tmp_path / "own.yaml").write_text(body)
    p = config.load_profile("own", str(tmp_path))
    assert p.structure.question == r"^Q(\d+)" and p.structure.references == ((r"R(\d)", "clause_refs"),)
    (tmp_path / "bad.yaml").write_text("name: bad\n")
    for name in ("bad", "none"):
        with pytest.raises(ValueError):
            config.load_profile(name, str(tmp_path))
    (tmp_path / "tight.yaml").write_text("v2_sparse_cover: 0.2\n")
    assert config.load_policy("tight", str(tmp_path)).v2_sparse_cover == 0.2 and config.load_policy() == config.Policy()


def test_collection_folders(tmp_path):
    assert sources.profile_of(str(tmp_path)) == "contract"
    sources.set_profile(str(tmp_path), "document")
    assert sources.profile_of(str(tmp_path)) == "document"
    (tmp_path / "chunks.jsonl").write_text("x")
    assert len(sources.migrate_layout(str(tmp_path), "c")) == 2 and (tmp_path / "chunks.jsonl").exists()
    sources.migrate_layout(str(tmp_path), "c", apply=True)
    assert (tmp_path / "c" / "chunks.jsonl").read_text() == "x" and sources.migrate_layout(str(tmp_path), "c") == []


def test_captions_once_a_page(spark):
    chunks = spark.createDataFrame([chunk(1, kind="drawing"), chunk(2, kind="drawing"), chunk(3, caption=None), chunk(4, kind="drawing", page=2)], CHUNK)
    images = spark.createDataFrame([("f.pdf", 1, b"img")], "file string, page int, image binary")
    slots = Slots(caption=lambda image, nearby: F.concat(F.lit("seen "), nearby))
    got = {r["id"]: r["caption"] for r in attach_captions(chunks, images, slots).collect()}
    assert got == {"c1": "seen t", "c2": "seen t", "c3": None, "c4": "seen t"}
    silent = {r["id"]: r["caption"] for r in attach_captions(chunks, images, Slots()).collect()}
    assert silent["c1"] == "" and silent["c3"] is None


def test_rows_that_fail_are_null(spark):
    f = row_udf(lambda x: 10 // x, "int")
    assert [r["r"] for r in spark.createDataFrame([(5,), (0,)], "x int").select(f(F.col("x")).alias("r")).collect()] == [2, None]


PAGES = [("contract.pdf", 1, "Section 1\nThe bridge is built by Acme. It spans a river.\n\nQuestion No. A/1\nWho builds the bridge?\nAnswer: Acme builds the bridge.", "text"), ("contract.pdf", 2, "Question No. A/2\nWhat about the roof?\nAnswer: The roof is steel.", "text")]


def test_search_and_ask(spark):
    c = plans.ingest(spark.createDataFrame(PAGES, "file string, page_num int, text string, page_kind string"))
    q = spark.createDataFrame([("r", "the roof steel"), ("b", "who builds the bridge")], "query_id string, text string")
    first = {r["query_id"]: r for r in plans.search(c, q, 1).collect()}
    assert first["r"]["page"] == 2 and "bridge" in first["b"]["text"]
    assert plans.search(c, q, 3, rerank=True).count() == 6
    answer = {r["query_id"]: r for r in plans.ask(c, q, Slots()).collect()}
    assert answer["r"]["citations"] and answer["r"]["confidence"] == "medium" and "[contract.pdf p." in answer["r"]["text"]
    assert {r["confidence"] for r in plans.ask(c, q).collect()} == {"none"}
    cases = spark.createDataFrame([("r", "the roof steel", [("contract.pdf", 2, 2)], ["steel"], "x"), ("b", "bridge", [("other.pdf", 1, 1)], [], None)], "case_id string, question string, expected_sources array<struct<file:string,page_min:int,page_max:int>>, expected_keywords array<string>, category string")
    rows, means = plans.evaluate(c, cases, Slots())
    overall = means.where("overall").first()
    assert rows.count() == 2 and overall["recall_5"] == 0.5 and overall["n_cases"] == 2 and overall["keyword_rate"] >= 0.5
    for bad in (("", 5), ("x" * 1001, 5), ("q", 0), ("q", 51)):
        with pytest.raises(ValueError):
            plans.check_request(*bad)


def test_reports_and_galleries(spark, tmp_path):
    means = spark.createDataFrame([(True, None, 2, 0.5), (False, "x", 2, 0.5)], "overall boolean, category string, n_cases long, recall double")
    sources.write_report(means, spark.range(2), str(tmp_path), "t")
    body = json.loads((tmp_path / "t.json").read_text())
    assert body["n_cases"] == 2 and body["metrics_mean"] == {"recall": 0.5} and body["metrics_by_category"]["x"]["n_cases"] == 2
    pages = spark.createDataFrame([(7, 0.25, ["boxes=1<2"], "a | b")], "page_key int, margin double, flag_reasons array<string>, text string")
    sources.write_gallery(pages, str(tmp_path / "g"))
    assert "a \\| b" in (tmp_path / "g" / "index.md").read_text() and (tmp_path / "g" / "7.txt").exists()


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text("\n".join(json.dumps({"file": f, "page_num": p, "text": t, "page_kind": k}) for f, p, t, k in PAGES))
    pages = streams.page_stream(spark, str(src), "file string, page_num int, text string, page_kind string")
    streams.chunk_stream(pages, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 3 and got.select("batch").distinct().count() == 1

    log = tmp_path / "log"
    log.mkdir()
    rows = [("h", "ocr", "p", "2024-01-01T00:00:00"), ("h", "ocr", "p", "2024-01-01T00:01:00"), ("g", "ocr", "p", "2024-01-01T00:02:00")]
    (log / "1.json").write_text("\n".join(json.dumps(dict(zip(("content_hash", "task_kind", "provider", "assigned_ts"), r))) for r in rows))
    stream = spark.readStream.schema("content_hash string, task_kind string, provider string, assigned_ts timestamp").json(str(log))
    streams.first_records(stream).writeStream.format("memory").queryName("first_records").trigger(availableNow=True).start().awaitTermination()
    assert spark.table("first_records").count() == 2

    prog = tmp_path / "prog"
    prog.mkdir()
    (prog / "1.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01T00:0{m}:00", "status": "done", "cost_usd": 0.5}) for m in (0, 1, 6)))
    stream = spark.readStream.schema("ts timestamp, status string, cost_usd double").json(str(prog))
    streams.progress_windows(stream).writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["pages"] for r in spark.table("windows").collect()) == [1, 2]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("Section 1\nThe bridge is built by Acme.\fThe roof is steel. See Drawing No. T/1/2A.")
    c = str(tmp_path / "col")
    cli.main(["ingest", c, str(tmp_path / "a.txt")])
    cli.main(["search", c, "roof steel", "--k", "1"])
    cli.main(["ask", c, "roof steel"])
    cli.main(["refs", c])
    cli.main(["refs", c, "--type", "drawing", "--value", "T/1/2A"])
    cli.main(["show-chunks", c])
    (tmp_path / "d.yaml").write_text("entities:\n  ORG: [Acme]\n")
    cli.main(["redact-preview", str(tmp_path / "a.txt"), str(tmp_path / "d.yaml")])
    cli.main(["dispatch-plan", str(tmp_path / "a.txt"), "x,y", "--provenance", str(tmp_path / "prov")])
    cli.main(["batch-ingest", str(tmp_path / "a.txt"), str(tmp_path / "progress"), "--budget", "1"])
    (tmp_path / "s.jsonl").write_text('{"page_num": 1, "boxes": 209, "box_coverage": 0.1301}\n')
    cli.main(["policy-trace", str(tmp_path / "s.jsonl")])
    (tmp_path / "m.jsonl").write_text('{"page_key": 1, "boxes": 2, "alnum_ratio": 0.5, "mean_score": 0.5, "min_score": 0.4, "low_score_ratio": 1.0, "garbled_ratio": 0.0, "text": "t"}\n')
    cli.main(["ocr-quality", str(tmp_path / "m.jsonl"), "--flag-below", "min_score:0.7"])
    cli.main(["ocr-gallery", str(tmp_path / "m.jsonl"), str(tmp_path / "gal"), "--flag-below", "min_score:0.7"])
    (tmp_path / "cases.jsonl").write_text('{"id": "1", "question": "roof", "expected_sources": [], "expected_keywords": [], "category": "x"}\n')
    for _ in range(2):
        cli.main(["evaluate", c, str(tmp_path / "cases.jsonl"), "--out", str(tmp_path / "rep")])
    report = str(next((tmp_path / "rep").glob("*.json")))
    cli.main(["eval-compare", report, report])
    out = capsys.readouterr().out
    assert "steel" in out and "<ORG_1>" in out and "drawing" in out and "records added" in out and (tmp_path / "gal" / "index.md").exists()
