"""Known answers of the chunker."""

import pyarrow as pa
import pytest

from ferrule.config import CONTRACT_STRUCTURE, DOCUMENT
from ferrule.operators import chunking
from ferrule.schema import CHUNK
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def chunks(*pages, structure=CONTRACT_STRUCTURE, file="dir/My File.v2.pdf"):
    rows = [(i + 1, *(p if isinstance(p, tuple) else (p, "text"))) for i, p in enumerate(pages)]
    return chunking.chunk_file(file, rows, structure)


def test_questions_cut_the_document():
    out = chunks("Section 1\nOverview of works.\n\nQuestion No. ACME/TRACKWORK/16\nQ?\nAnswer: yes.\n", "Question No: ACME/PROC/04\nHow?\nClause 7.3.1\nsee Drawing No. T/PRJ/CWD/WS/2101A")
    assert [(c["chunk_type"], c["question_no"]) for c in out] == [("paragraph", None), ("qa_pair", "ACME/TRACKWORK/16"), ("qa_pair", "ACME/PROC/04")]
    assert [c["id"] for c in out] == ["My_File.v2:1:0", "My_File.v2:1:1", "My_File.v2:1:2"]  # a header after a page that ends in a line end is the former page's
    assert out[0]["section_path"] == "Section 1" and out[2]["section_path"] == "Section 1 > Clause 7.3.1"
    assert out[2]["drawing_refs"] == ["T/PRJ/CWD/WS/2101A"] and out[2]["clause_refs"] == ["7.3.1"]


def test_reference_stops_before_trailing_letter_part():
    assert chunks("Drawing No. T/PRJ/CWD/CV/7021/A is it")[0]["drawing_refs"] == ["T/PRJ/CWD/CV/7021"]


def test_small_paragraphs_gather():
    a, b, c = "a" * 150, "b" * 60, "c" * 50
    out = chunks(f"{a}\n\n{b}\n \n{c}", structure=DOCUMENT.structure)
    assert [x["text"] for x in out] == [f"{a}\n\n{b}", c]


@pytest.mark.parametrize("n", [800, 999, 1000, 1001, 1600, 1601, 5000])
def test_long_texts_are_cut(n):
    text = ("word " * n)[:n]
    parts = [t for t, _ in chunking.pieces(text, 0, chunking.PARAGRAPH_MOST)]
    assert "".join(parts) == text and (n <= 1000) == (len(parts) == 1) and all(len(p) <= 1000 for p in parts)


def test_cut_after_the_last_sentence_in_reach():
    text = "x" * 500 + ". " + "y" * 100 + "! " + "z" * 900
    assert [t[-1] for t, _ in chunking.pieces(text, 0, 1000)][:1] == ["!"]


def test_drawing_pages_come_last_and_may_be_empty():
    out = chunks(("", "drawing"), "Some text on a page.", ("  Dwg. A/1  ", "drawing"))
    assert [(c["chunk_type"], c["page"], c["text"]) for c in out] == [("paragraph", 2, "Some text on a page."), ("drawing", 1, ""), ("drawing", 3, "Dwg. A/1")]
    assert out[2]["drawing_refs"] == ["A/1"] and out[1]["section_path"] is None


def test_neutral_profile_has_no_structure():
    out = chunks("Question No. 1\nSection 2\nClause 3.1", structure=DOCUMENT.structure)
    assert len(out) == 1 and out[0]["question_no"] is None and out[0]["section_path"] is None and out[0]["clause_refs"] == []


def test_empty_inputs():
    assert chunks() == [] and chunks("", " \n ") == []


def test_tables_equal_files(spark):
    rows = [("f1", 2, "Question No. 2\nB", "text"), ("f1", 1, "Section 4\nA", "text"), ("f2", 1, None, "text"), ("f2", 2, "d", "drawing")]
    got = chunking.chunk_pages(spark.createDataFrame(rows, chunking_schema)).orderBy("file", "ord").collect()
    assert [(r["id"], r["chunk_type"], r["text"]) for r in got] == [("f1:1:0", "paragraph", "Section 4\nA"), ("f1:2:1", "qa_pair", "Question No. 2\nB"), ("f2:2:0", "drawing", "d")]


chunking_schema = "file string, page_num int, text string, page_kind string"


def test_expression_equals_function(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text IS NOT NULL")
    rows = docs.select("text", chunking.split_long(F.col("text")).alias("p")).collect()
    for r in rows:
        assert [(p["text"], p["start"]) for p in r["p"]] == list(chunking.pieces(r["text"], 0, chunking.PARAGRAPH_MOST))


def test_chunks_leave_in_bounded_batches(monkeypatch):
    """However many files a batch has, and however long one is, a task holds some chunks at a time."""
    monkeypatch.setattr(chunking, "EMITTED", 1000)
    pages = lambda n: [{"page_num": i, "text": f"Some words of page {i}. " * 20, "page_kind": "text"} for i in range(n)]
    files = [{"file": f"f{i}.pdf", "pages": pages(30 if i == 3 else 2)} for i in range(40)]
    schema = to_arrow_schema(StructType.fromDDL(f"{CHUNK}, ord long"))
    found = list(chunking.chunk_batches(iter([pa.RecordBatch.from_pylist(files)]), CONTRACT_STRUCTURE, schema))
    expected = [{**r, "ord": n} for f in files for n, r in enumerate(chunking.chunk_file(f["file"], [tuple(p.values()) for p in f["pages"]]))]
    assert [r for b in found for r in b.to_pylist()] == expected
    assert len(found) > 20 and max(sum(map(len, b.column("text").to_pylist())) for b in found) < 1000 + chunking.QUESTION_MOST
