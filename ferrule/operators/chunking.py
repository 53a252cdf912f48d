"""Structure-aware chunking of page text.

A file is one group: its pages are joined, cut at question headers, and the rest
cut into paragraphs.  ``split_long`` alone is also there as a column expression.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ferrule.config import CONTRACT_STRUCTURE, Structure
from ferrule.schema import CHUNK

#: Fixed values, in characters.
QUESTION_MOST, PARAGRAPH_MOST = 2000, 1000
TINY, CUT_FROM, CUT_TO = 200, 400, 800
#: Characters, and rows, of chunks that leave a task at a time.
EMITTED, EMITTED_ROWS = 4 << 20, 4096
_LINES = re.IGNORECASE | re.MULTILINE
_TERMINATOR = re.compile(r"[.!?。！？](?=\s|$)")
_BLANK = re.compile(r"\n\s*\n")


def cuts(text: str) -> list[int]:
    """Ends of the pieces of a long text: after the last sentence in reach, or hard."""
    ends, at = [], 0
    while len(text) - at > CUT_TO:
        window = text[at + CUT_FROM : at + CUT_TO]
        stops = [m.end() for m in _TERMINATOR.finditer(window)]
        at += CUT_FROM + stops[-1] if stops else CUT_TO
        ends.append(at)
    return [*ends, len(text)] if at < len(text) else ends


def pieces(text: str, offset: int, most: int) -> Iterator[tuple[str, int]]:
    """``text`` whole if it is short enough, else cut; each with its offset."""
    start = 0
    for end in cuts(text) if len(text) > most else [len(text)]:
        yield text[start:end], offset + start
        start = end


def paragraphs(text: str) -> Iterator[tuple[str, int]]:
    """Paragraphs between blank lines with their offsets; small ones gather until they are large enough."""
    ends = [m.span() for m in _BLANK.finditer(text)]
    bounds = zip([0, *(e for _, e in ends)], [*(s for s, _ in ends), len(text)], strict=True)
    gathered, begin, size = [], 0, 0
    for start, end in bounds:
        part = text[start:end]
        if not part.strip():
            continue
        if not gathered:
            begin, size = start, -2
        gathered.append(part)
        size += len(part) + 2
        if size >= TINY:
            yield "\n\n".join(gathered), begin
            gathered = []
    if gathered:
        yield "\n\n".join(gathered), begin


class _Headers:
    """The header that holds at an offset: the last one whose line was read by then."""

    def __init__(self, pattern: str | None, text: str):
        found = [(m.end(), m.group(1).strip(), m) for m in re.finditer(pattern, text, _LINES)] if pattern else []
        self.ends, self.names = [e for e, _, _ in found], [n for _, n, _ in found]
        self.pattern, self.text = pattern, text

    def at(self, end: int) -> str | None:
        k = bisect_right(self.ends, end)
        # text that ends inside a header may show a shorter one
        if self.pattern and k < len(self.ends):
            line = self.text.rfind("\n", 0, end) + 1
            m = re.compile(self.pattern, _LINES).search(self.text[:end], line)
            if m:
                return m.group(1).strip()
        return self.names[k - 1] if k else None


def chunk_file(file: str, pages: list[tuple[int, str, str]], structure: Structure = CONTRACT_STRUCTURE) -> list[dict]:
    """Chunks of one file; ``pages``: number, text, kind, in order."""
    plain = [(n, t) for n, t, kind in pages if kind != "drawing"]
    starts, at = [], 0
    for _, t in plain:
        starts.append(at)
        at += len(t) + 1
    full = "".join(t + "\n" for _, t in plain)
    questions = list(re.finditer(structure.question, full, _LINES)) if structure.question else []
    edges = [*(m.start() for m in questions), len(full)]
    sections, clauses = _Headers(structure.section, full), _Headers(structure.clause, full)
    rules = [(re.compile(p, re.IGNORECASE), target) for p, target in structure.references]
    stem = (file.rsplit("/", 1)[-1].rsplit(".", 1)[0]).replace(" ", "_")
    out: list[dict] = []

    def emit(text: str, page: int, kind: str, path: str | None, question: str | None) -> None:
        found = {target: sorted(set(rule.findall(text))) for rule, target in rules}
        out.append({
            "id": f"{stem}:{page}:{len(out)}", "text": text, "file": file, "page": page, "chunk_type": kind, "section_path": path, "revision": None,
            "drawing_refs": found.get("drawing_refs", []), "clause_refs": found.get("clause_refs", []), "question_no": question, "caption": None, "bbox": None,
        })

    def place(text: str, offset: int, kind: str, upto: int, question: str | None = None) -> None:
        if text.strip():
            page = plain[max(bisect_right(starts, offset) - 1, 0)][0]
            path = " > ".join(h for h in (sections.at(upto), clauses.at(upto)) if h)
            emit(text.strip(), page, kind, path or None, question)

    for paragraph, offset in paragraphs(full[: edges[0]]):
        for text, begin in pieces(paragraph, offset, PARAGRAPH_MOST):
            place(text, begin, "paragraph", begin + len(text))
    for m, end in zip(questions, edges[1:], strict=True):
        for text, begin in pieces(full[m.start() : end], m.start(), QUESTION_MOST):
            place(text, begin, "qa_pair", end, m.group(1).strip())
    for number, text, kind in sorted(pages, key=lambda p: p[0]):
        if kind == "drawing":
            emit(text.strip(), number, "drawing", None, None)
    return out


def chunk_batches(batches: Iterator[pa.RecordBatch], structure: Structure, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Chunks of files (``file, pages``): files become Python objects one by one, and chunks leave some megabytes at a time."""
    for batch in batches:
        rows, size = [], 0
        for i in range(batch.num_rows):
            file, group = batch.column("file")[i].as_py(), batch.column("pages")[i].values
            numbers, texts, kinds = (group.field(name).to_pylist() for name in ("page_num", "text", "page_kind"))
            for n, r in enumerate(chunk_file(file, [(p, t or "", kind) for p, t, kind in zip(numbers, texts, kinds, strict=True)], structure)):
                rows.append({**r, "ord": n})
                size += len(r["text"])
                if size >= EMITTED or len(rows) >= EMITTED_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


def chunk_pages(pages: DataFrame, structure: Structure = CONTRACT_STRUCTURE) -> DataFrame:
    """Chunks of all files of ``pages`` (``file, page_num, text, page_kind``), with ``ord``, their order in the file.

    A file's pages meet in one row, and files go to Python in Arrow batches: a
    group of its own for each file would cost more than its chunks.
    """
    kinds = StructType.fromDDL(f"{CHUNK}, ord long")
    schema = to_arrow_schema(kinds)
    page = F.struct("page_num", "text", "page_kind")
    files = pages.select("file", "page_num", "text", "page_kind").groupBy("file").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    return files.mapInArrow(lambda batches: chunk_batches(batches, structure, schema), kinds)


def split_long(text: Column, most: int = PARAGRAPH_MOST) -> Column:
    """``start, text`` of the pieces of a text, as an expression: a fold along the text."""
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,text:string>>").alias("done"))
    steps = F.sequence(F.lit(0), F.floor(F.length(text) / CUT_FROM).cast("int"))

    def step(acc: Column, _: Column) -> Column:
        left = F.length(text) - acc["at"]
        window = F.substr(text, acc["at"] + CUT_FROM + 1, F.lit(CUT_TO - CUT_FROM))
        head = F.length(F.regexp_extract(window, r"(?s)^(.*[.!?。！？])(?=\s|$)", 1))
        size = F.when(left <= CUT_TO, left).when(head > 0, head + CUT_FROM).otherwise(CUT_TO)
        piece = F.struct(acc["at"].alias("start"), F.substr(text, acc["at"] + 1, size).alias("text"))
        return F.when(left > 0, F.struct((acc["at"] + size).alias("at"), F.concat(acc["done"], F.array(piece)).alias("done"))).otherwise(acc)

    whole = F.array(F.struct(F.lit(0).alias("start"), text.alias("text")))
    return F.when(F.length(text) <= most, whole).otherwise(F.aggregate(steps, state, step, lambda acc: acc["done"]))


def page_starts(pages: DataFrame) -> DataFrame:
    """``pages`` with ``start``: where a page begins in its file's joined text."""
    from pyspark.sql import Window

    before = Window.partitionBy("file").orderBy("page_num").rowsBetween(Window.unboundedPreceding, -1)
    return pages.withColumn("start", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0)))


def page_of_offset(offsets: DataFrame, pages: DataFrame) -> DataFrame:
    """``offsets`` (``file, offset``) with the page that holds each: an as-of join, by one window over both."""
    from pyspark.sql import Window

    left = offsets.select("file", F.col("offset").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("page"))
    right = page_starts(pages).select("file", F.col("start").alias("at"), F.lit(0).alias("kind"), F.col("page_num").alias("page"))
    upto = Window.partitionBy("file").orderBy("at", "kind", "page").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn("page", F.last("page", ignorenulls=True).over(upto)).where("kind = 1").select("file", F.col("at").alias("offset"), "page")


def drawing_pages(pages: DataFrame) -> DataFrame:
    """The pages that go to the captioning lane."""
    return pages.where("page_kind = 'drawing'")


def text_pages(pages: DataFrame) -> DataFrame:
    return pages.where(F.coalesce(F.col("page_kind"), F.lit("text")) != "drawing")
