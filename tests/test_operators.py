"""Known answers of single operators."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from ferrule import config
from ferrule.functions import text as T
from ferrule.operators import batch, bm25, citations, dispatch, evaluation, fusion, geometry, graph, quality, redaction, tables, vector


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expression(F.col("c")).alias("r")).first()["r"]


# -- text


@pytest.mark.parametrize(("text", "expected"), [
    ("See [a.pdf p.3] and [b c.pdf p.12].", [("a.pdf", 3), ("b c.pdf", 12)]), ("[TQA 12] TQA p.12", []), ("[x p.1][x p.1]", [("x", 1), ("x", 1)]),
])
def test_citations(spark, text, expected):
    assert [(r["file"], r["page"]) for r in one(spark, text, T.citations)] == expected


def test_sentences(spark):
    assert one(spark, "  One. Two!\nThree？ 四。五 six", T.sentences) == ["One.", "Two!", "Three？", "四。五 six"]
    assert one(spark, "事实. [F p.1]", T.sentences) == ["事实.", "[F p.1]"]


def test_strip_knows_unicode_space(spark):
    assert one(spark, "\n\t x　  ", T.strip) == "x" and one(spark, " a \n  b ", T.squeeze) == "a b"


def test_model_replies(spark):
    assert one(spark, "<think>a</think> yes <think>b", T.without_thoughts) == "yes"
    assert one(spark, '```json\n{"score": 1.7}\n```', T.judge_score) == 1.0
    for bad in ("", "no", '{"score": "x"}', '{"score": "NaN"}', "{}", None):
        assert one(spark, bad, T.judge_score) is None
    assert tuple(one(spark, '{"caption_zh": "图", "entities": "x"}', T.caption_of)) == ("图", [])
    assert tuple(one(spark, "garbage", T.caption_of)) == ("", [])
    assert one(spark, '{"message": "m"}', T.last_event_text) == "m"
    assert one(spark, '{"text": "a"}\nnoise\n{"content": "b"}\n{"other": 1}', T.last_event_text) == "b"


def test_names(spark):
    assert one(spark, "dir/a b.tar.gz", T.file_stem) == "a_b.tar" and one(spark, "plain", T.file_stem) == "plain"
    assert one(spark, "org/model v2!", lambda c: T.slug(c, "default")) == ".org-model-v2" and one(spark, "default", lambda c: T.slug(c, "default")) == ""
    assert [one(spark, n, T.safe_name) for n in ("a.pdf", "../a", "a/b", "a\\b", "")] == [True, False, False, False, False]


def test_section_top(spark):
    assert [one(spark, p, T.section_top) for p in ("Section 4 > Clause 2", "section 9", "Clause 2", None)] == ["Section 4", "section 9", None, None]


def test_words(spark):
    assert one(spark, "Größe-10 中文ab, x_1", T.words) == ["größe", "10", "中", "文", "ab", "x_1"]


def test_caption_is_tri_state(spark):
    rows = spark.createDataFrame([("t", None), ("t", ""), ("t", "c")], "t string, c string").select(T.indexable(F.col("t"), F.col("c")).alias("r")).collect()
    assert [r["r"] for r in rows] == ["t", "t", "t\n\nCaption: c"]


# -- dispatch


@pytest.mark.parametrize(("pool", "expected"), [(["alpha", "beta"], ["beta", "beta", "alpha", "alpha"]), (["alpha", "beta", "gamma"], ["beta", "beta", "beta", "alpha"])])
def test_providers(spark, pool, expected):
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in ("", "page-1", "page-2", "page-3")]
    assert [one(spark, f" {x.upper()} ", lambda c: dispatch.provider(c, pool)) for x in digests] == expected
    assert [pool[int(x, 16) % len(pool)] for x in digests] == expected
    assert one(spark, digests[0], lambda c: dispatch.provider(c, [f" {p} " for p in pool])) == expected[0]
    for bad in ("abc", digests[0] + "0", None):
        with pytest.raises(Exception, match="SHA-256"):
            one(spark, bad, lambda c: dispatch.provider(c, pool))


def test_pools_are_checked(spark):
    for bad in ([], ["a", "a"], ["a", " a"], ["a", " "]):
        with pytest.raises(ValueError, match="pool"):
            dispatch.provider(F.lit("x"), bad)


# -- retrieval


def test_bm25_against_the_formula(spark):
    docs = ["the cat sat", "the dog sat on the mat", "", "birds fly"]
    toks = [d.split() or [bm25.EMPTY] for d in docs]
    n, avg = 4, sum(map(len, toks)) / 4
    df = {t: sum(t in x for x in toks) for x in toks for t in x}
    raw = {t: math.log(n - k + 0.5) - math.log(k + 0.5) for t, k in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if v < 0 else v for t, v in raw.items()}
    query = "the sat the"
    expected = [round(sum(idf[t] * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for t in query.split()), 6) for x in toks]
    chunks = spark.createDataFrame([(i, i, d) for i, d in enumerate(docs)], "chunk_id int, ord int, text string")
    asked = spark.createDataFrame([(1, query), (2, "zebra"), (3, "...")], "query_id int, text string")
    got = bm25.top_k(bm25.build(chunks), asked, 4).orderBy("query_id", "rank").collect()
    order = sorted(range(4), key=lambda i: (-expected[i], i))
    assert [(r["chunk_id"], r["score"]) for r in got if r["query_id"] == 1] == [(i, expected[i]) for i in order]
    assert [(r["chunk_id"], r["score"]) for r in got if r["query_id"] == 2] == [(i, 0.0) for i in range(4)]
    assert not [r for r in got if r["query_id"] == 3]


def test_rrf(spark):
    rank = lambda ids: spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(ids)], "query_id int, chunk_id string, rank int")
    got = fusion.fuse(rank("abc"), rank("cbd")).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == ["c", "b", "a", "d"] and got[0]["score"] == pytest.approx(1 / 63 + 1 / 61)
    assert [r["chunk_id"] for r in fusion.fuse(rank("ab"), rank("ba")).orderBy("rank").collect()] == ["a", "b"]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0]), (4, None), (5, [2.0, 0.0])], "chunk_id int, embedding array<float>")
    q = spark.createDataFrame([("x", [3.0, 0.0])], "query_id string, embedding array<float>")
    assert [(r["chunk_id"], round(r["score"], 4)) for r in vector.top_k(v, q, 3).orderBy("rank").collect()] == [(1, 1.0), (5, 1.0), (2, 0.7071)]
    assert vector.top_k(v, q.limit(0), 3).count() == 0
    assert one(spark, [1.0, 0.0], lambda c: vector.cosine(c, F.array(F.lit(0.0), F.lit(2.0))), "array<double>") == 0


# -- answers


def context():
    return F.array(F.struct(F.lit("a.pdf").alias("file"), F.lit(3).alias("page")))


@pytest.mark.parametrize(("text", "kept", "dropped"), [
    ("True [a.pdf p.3]. False [a.pdf p.4]. None.", "True [a.pdf p.3].", 2), ("Both [b p.1][a.pdf p.3].", "Both [b p.1][a.pdf p.3].", 0),
    ("Ghost [g p.1]. Ghost [g p.2].", citations.NO_ANSWER, 2), (f" {citations.NO_ANSWER}\n", citations.NO_ANSWER, 0), ("", citations.NO_ANSWER, 0),
])
def test_citation_checks(spark, text, kept, dropped):
    r = one(spark, text, lambda c: citations.validated(c, context()))
    assert (r["text"], r["n_dropped"]) == (kept, dropped) and all((c["file"], c["page"]) == ("a.pdf", 3) for c in r["citations"])


@pytest.mark.parametrize(("scores", "level"), [([0.7] * 5, "medium"), ([0.75] * 4, "high"), ([0.5] * 5, "low"), ([], "low"), ([1.0] * 5 + [0.0] * 9, "high")])
def test_confidence(spark, scores, level):
    assert one(spark, scores, citations.confidence, "array<double>") == level


def test_prompt_escapes(spark):
    r = one(spark, "a<b>", lambda c: citations.prompt_block(F.lit('f"'), F.lit(2), F.lit("text"), c))
    assert r == '<context_chunk file="f&quot;" page="2" type="text">\na&lt;b&gt;\n</context_chunk>'


# -- evaluation


def test_recall_and_rates(spark):
    source = [("a", 2, 4)]
    cases = spark.createDataFrame([(1, source), (2, source), (3, [])], "case_id int, expected_sources array<struct<file:string,page_min:int,page_max:int>>")
    hits = spark.createDataFrame([(1, 1, "b", 3), (1, 2, "a", 4), (2, 1, "a", 5), (3, 1, "a", 3)], "case_id int, rank int, file string, page int")
    assert {r["case_id"]: r["recall"] for r in evaluation.recall(cases, hits, 5).collect()} == {1: 1.0, 2: 0.0, 3: 0.0}
    assert evaluation.recall(cases, hits, 1).where("recall > 0").count() == 0 and evaluation.recall(cases, hits, 0).where("recall > 0").count() == 0
    assert one(spark, ["Bridge", "x"], lambda c: evaluation.keyword_rate(F.lit("the BRIDGE"), c), "array<string>") == 0.5
    assert one(spark, [], lambda c: evaluation.keyword_rate(F.lit("t"), c), "array<string>") == 0.0


def test_reports_are_compared(spark):
    make = lambda rows: spark.createDataFrame(rows, "category string, metric string, value double")
    got = evaluation.compare(make([(None, "r", 0.5), ("x", "r", 1.0)]), make([(None, "r", 0.75), ("y", "r", 0.25)])).collect()
    assert {(r["category"], r["a"], r["b"], r["delta"]) for r in got} == {(None, 0.5, 0.75, 0.25), ("x", 1.0, None, None), ("y", None, 0.25, None)}


# -- graph


def test_graph(spark):
    rows = [("c1", "f", 1, "t", ["D1", " D1 ", ""], ["1.1"], "Q1", None, "Section 2 > Clause 1"), ("c2", "f", 1, "t", ["D2"], [], None, "R1", "Clause 3")]
    chunks = spark.createDataFrame(rows, "id string, file string, page int, chunk_type string, drawing_refs array<string>, clause_refs array<string>, question_no string, revision string, section_path string")
    edges = graph.mentions(chunks)
    assert {tuple(r) for r in edges.collect()} == {("c1", "drawing", "D1"), ("c1", "clause", "1.1"), ("c1", "question_no", "Q1"), ("c1", "section", "Section 2"), ("c2", "drawing", "D2"), ("c2", "revision", "R1")}
    assert graph.stats(edges, chunks).first().asDict() == {"chunks": 2, "entities": 6, "mentions": 6, "drawings": 2, "clauses": 1, "question_nos": 1, "sections": 1, "revisions": 1}
    assert graph.reindex(edges, chunks).count() == 6
    assert [r["chunk_id"] for r in graph.mentions_of(edges, chunks, "drawing", "D1").collect()] == ["c1"]


# -- geometry


def boxes(spark, *rects):
    rows = [(1, i, float(a), float(b), float(c), float(d), t) for i, (t, a, b, c, d) in enumerate(rects)]
    return spark.createDataFrame(rows, "page_key int, box_idx long, x0 double, y0 double, x1 double, y1 double, txt string")


TWO = [("L1", 100, 100, 450, 130), ("R1", 520, 105, 900, 135), ("L2", 100, 140, 450, 170), ("R2", 520, 145, 900, 175)]


def test_two_columns(spark):
    b = boxes(spark, *TWO)
    g = geometry.page_geometry(b, 1000, 1400).first()
    assert g["n_columns"] == 2 and g["order_divergence"] == pytest.approx(1 / 6)
    o = geometry.reading_order(b, 1000, 1400)
    assert geometry.page_text(o).first()["text"] == "L1 R1\nL2 R2" and geometry.page_text(o, True).first()["text"] == "L1\nL2\nR1\nR2"


def test_title_over_two_columns(spark):
    o = geometry.reading_order(boxes(spark, ("TITLE", 100, 20, 900, 50), *TWO), 1000, 1400)
    assert geometry.page_text(o, True).first()["text"] == "TITLE\nL1\nL2\nR1\nR2"


def test_gaps_and_coverage(spark):
    g = geometry.page_geometry(boxes(spark, ("a", 100, 100, 300, 130), ("b", 600, 102, 900, 132)), 1000, 1400).first()
    assert g["max_band_gap"] == pytest.approx(0.3)
    g = geometry.page_geometry(boxes(spark, ("a", 100, 100, 300, 200), ("b", 100, 300, 300, 400)), 1000, 1400).first()
    assert g["max_band_gap"] is None and g["box_coverage"] == pytest.approx(40000 / 1400000)


def test_strips_and_the_column_guard(spark):
    s = geometry.strips(boxes(spark, ("a", 0, 100, 9, 130), ("b", 0, 135, 9, 165), ("c", 0, 225, 9, 255)), 1400).orderBy("box_idx").collect()
    assert [r["strip"] for r in s] == [0, 0, 1]
    pair = boxes(spark, ("a", 100, 100, 300, 130), ("b", 600, 102, 900, 132))
    columns = lambda least: [r["col"] for r in geometry.columns(pair, 1000, least=least).orderBy("box_idx").collect()]
    assert columns(1) == [0, 1] and columns(2) == [0, 0]


# -- quality and routing


CALIBRATION = [(65, 0.0379, "drawing"), (68, 0.0365, "drawing"), (209, 0.1301, "drawing"), (25, 0.0158, "drawing"), (60, 0.0281, "drawing"), (2, 0.0074, "text"), (4, 0.0210, "text"), (3, 0.0190, "text"), (146, 0.2026, "text")]


def test_box_routes(spark):
    s = spark.createDataFrame([(i, b, c, None) for i, (b, c, _) in enumerate(CALIBRATION)], "page_num int, boxes int, box_coverage double, dark_ratio double")
    got = quality.trace(s, config.Policy()).orderBy("page_num").collect()
    assert [r["route"] for r in got] == [r for _, _, r in CALIBRATION]
    flips = quality.flips(s, config.Policy(), config.Policy(v2_fragment_box_frac=0.0005)).where("boxes = 209").first()
    assert (flips["route_a"], flips["route_b"]) == ("drawing", "text")


@pytest.mark.parametrize(("boxes", "cover", "dark", "route"), [(None, 0.1, 0.9, "text"), (0, 0.0, None, "drawing"), (5, 0.2, 0.6, "drawing"), (90, 0.05, 0.01, "text"), (90, 0.05, 0.03, "drawing"), (5, 0.2, 0.1, "text")])
def test_ink_rules(spark, boxes, cover, dark, route):
    s = spark.createDataFrame([(1, boxes, cover, dark)], "page_num int, boxes int, box_coverage double, dark_ratio double")
    assert quality.trace(s, config.Policy()).first()["route"] == route


def test_mass_and_rotation(spark):
    assert one(spark, "ab cd", lambda c: quality.mass(c, F.array(F.lit(0.8), F.lit(0.6)))) == pytest.approx(2.8)
    assert one(spark, "ab", lambda c: quality.mass(c, F.array().cast("array<double>"))) == 0
    rows = [(1, r, "x" * n, [0.5]) for r, n in ((0, 10), (90, 30), (180, 30), (270, 5))] + [(2, 0, "x", [0.9]), (2, 90, "x" * 99, [0.9])] + [(3, 0, "x" * 100, [0.5]), (3, 90, "x" * 109, [0.5])] + [(4, 0, "", []), (4, 90, "x", [0.5])]
    got = quality.best_rotation(spark.createDataFrame(rows, "page_key int, rotation int, text string, scores array<double>")).collect()
    assert {r["page_key"]: (r["rotation"], r["gated"]) for r in got} == {1: (90, True), 2: (0, False), 3: (0, True), 4: (90, True)}


def test_rules():
    for bad in ("nope:1", "boxes", "boxes:x", "boxes:nan"):
        with pytest.raises(ValueError):
            quality.parse_rule(bad, True)
    assert quality.parse_rule("boxes:3", False) == quality.Rule("boxes", 3.0, False)


@pytest.mark.parametrize("v", [0.5, 0.1234, 12.0, 123456.0, 0.0001, 0.0, 1.5, 99999.5, 0.33333333])
def test_general_numbers(spark, v):
    assert one(spark, v, quality.general, "double") == f"{v:g}"


def test_flags(spark):
    rows = spark.createDataFrame([(1, 0.5, 4), (2, None, 9), (3, 0.9, 1)], "page_key int, min_score double, boxes int")
    got = quality.flagged(rows, [quality.parse_rule("min_score:0.7", True), quality.parse_rule("boxes:5", False)]).orderBy("page_key").collect()
    assert [(r["flagged"], r["flag_reasons"]) for r in got] == [(True, ["min_score=0.5<0.7"]), (True, ["boxes=9>5"]), (False, [])]
    assert [r["margin"] for r in got] == [pytest.approx(0.2), 4.0, None]


def test_policies():
    assert config.policy_from({"rotate": False, "rescue_dpi": "400", "unknown": 1}).rescue_dpi == 400
    with pytest.raises(ValueError, match="rotate"):
        config.policy_from({"rotate": 1})


# -- tables


def test_cells_and_markdown(spark):
    html = "<table><tr><th>A</th><td> b\n|c </td></tr><tr><td><i>d</i></td></tr></table>"
    box = [10.0, 20.0, 60.0, 20.0, 60.0, 120.0, 10.0, 120.0]
    t = spark.createDataFrame([(1, html, [box, box, [-5.0, 0.0, 500.0, 0.0, 500.0, 50.0, -5.0, 50.0], box], [[0, 0, 0, 0], [0, 0, 1, 2], [1, 1, 0, 0], [1, 1, 1, 1]], 100, 200)],
                              "table_id int, html string, boxes array<array<double>>, logic array<array<int>>, page_w int, page_h int")
    cells = tables.cells(t).orderBy("ord").collect()
    assert [(r["x"], r["y"], r["w"], r["h"]) for r in cells] == [(0.1, 0.1, 0.5, 0.5)] * 2 + [(0.0, 0.0, 1.0, 0.25)] and len(cells) == 3
    assert tables.markdown(tables.cells(t)).first()["md"] == "| A | b \\|c |  |\n|---|---|---|\n| d |  |  |"
    lines = tables.elements(tables.cells(t), 90).first()["jsonl"].split("\n")
    assert len(lines) == 4 and lines[0] == '{"rotation":90,"cells":3}'


# -- redaction


def redacted(spark, texts, dictionary, strict=False, known=None):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    spans = redaction.entities(docs, dictionary, strict)
    m = redaction.mapping(spans, known)
    out = redaction.redact(docs, spans, m)
    back = {r["doc_id"]: r["text"] for r in redaction.restore(out, m).collect()}
    assert [back[i] for i in range(len(texts))] == texts
    rows = {r["doc_id"]: r for r in out.collect()}
    return [rows[i]["redacted_text"] for i in range(len(texts))], [rows[i]["spans_replaced"] for i in range(len(texts))], m


def test_longest_literal_wins(spark):
    d = redaction.Dictionary({"ORG": ("Acme Corp", "Acme Corp Pte. Ltd.")})
    texts, n, _ = redacted(spark, ["Acme Corp Pte. Ltd. is not just Acme Corp.", "none $1 \\ here", "Acme Corp"], d)
    assert texts == ["<ORG_1> is not just <ORG_2>.", "none $1 \\ here", "<ORG_2>"] and n == [2, 0, 1]


def test_overlaps_replace_one_span(spark):
    texts, n, _ = redacted(spark, ["Alpha Beta Gamma"], redaction.Dictionary({"X": ("Alpha Beta", "Beta Gamma")}))
    assert texts == ["<X_1> Gamma"] and n == [1]


def test_strict_leaves_no_names_or_numbers(spark):
    import re

    texts, _, _ = redacted(spark, ["On 12,000 days Mr. Smith & Sons paid 7 to A-Team x107 at 1-2"], redaction.Dictionary({"ORG": ("zzz",)}), True)
    rest = re.sub(redaction.PLACEHOLDER, "", texts[0])
    assert not re.search(r"[A-Z]|\d\d", rest) and " 7 " in rest


def test_numbers_go_on(spark):
    d = redaction.Dictionary({"ORG": ("a1", "b2", "c3")})
    known = spark.createDataFrame([("ORG", "b2", 7)], "entity_type string, entity_text string, idx int")
    _, _, m = redacted(spark, ["c3 b2 a1"], d, known=known)
    assert {(r["entity_text"], r["idx"]) for r in m.collect()} == {("b2", 7), ("c3", 8), ("a1", 9)}


def test_dictionaries_are_checked():
    for bad in ({}, {"org": ("x",)}):
        with pytest.raises(ValueError):
            redaction.Dictionary(bad)
    with pytest.raises(ValueError, match="pattern 0 of P") as e:
        redaction.Dictionary({}, {"P": ("(secret",)})
    assert "secret" not in str(e.value)


# -- batches


def test_budget_stops_after_two(spark):
    work = spark.createDataFrame([(1, i, 0.05) for i in range(5)], "lane int, seq int, cost_usd double")
    assert batch.within_budget(work, 0.10).count() == 2


def test_work_list(spark):
    files = spark.createDataFrame([("a", 3), ("b", 0)], "file string, n_pages int")
    seen = spark.createDataFrame([("a", 1, "done"), ("a", 2, "error"), ("a", 3, "skipped_cached")], "file string, page int, status string")
    assert [tuple(r) for r in batch.work_list(files, seen).collect()] == [("a", 2)]


def test_records_once(spark):
    make = lambda rows: spark.createDataFrame(rows, "content_hash string, provider string, assigned_at string, task_kind string")
    fresh = dispatch.new_records(make([("h1", "p", "1", "ocr")]), make([("h1", "p", "2", "ocr"), ("h2", "p", "4", "ocr"), ("h2", "p", "3", "ocr"), ("h1", "q", "5", "ocr")]))
    assert {(r["content_hash"], r["provider"], r["assigned_at"]) for r in fresh.collect()} == {("h2", "p", "3"), ("h1", "q", "5")}


def test_both_texts_of_a_page_from_one_gathering(spark):
    """Boxes without text, alone in their line or not; the layout is worked out once for both texts."""
    rows = [(1, 0, 1, 0, 3.0, "a"), (1, 1, 1, 0, 1.0, None), (1, 2, 1, 0, 4.0, "b"), (1, 3, 2, 0, 1.0, None), (1, 4, 3, 1, 2.0, None), (1, 5, 3, 1, 3.0, "c"), (2, 0, 0, 0, 1.0, None), (2, 1, 0, 0, 2.0, "x"), (3, 0, 0, 0, 1.0, None)]
    o = spark.createDataFrame(rows, "page_key long, box_idx long, line int, strip long, x0 double, txt string").withColumns({"col": F.lit(0), "region_line": F.lit(0)})
    both = geometry.page_texts(o, text=geometry.PLAIN, regions_text=geometry.BY_REGION)
    assert sorted(map(tuple, both.collect())) == [(1, "a b\n\nc", "a b\nc"), (2, "x", "x"), (3, "", "")]
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1
