"""Tables on pages: cells, regions and their Markdown."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.numbers import rounded
from ferrule.functions.text import cell_texts, markdown_cell

#: Fixed value: the least score of a detected table.
LEAST_SCORE = 0.5


def normal_box(box: Column, width: Column, height: Column) -> Column:
    """``x, y, w, h`` in shares of the page of a polygon ``[x, y] * n``, cut at the page's edges."""
    at = lambda odd: F.filter(box, lambda _, i: i % 2 == odd)
    clamp = lambda v, most: F.least(F.greatest(v, F.lit(0.0)), most.cast("double"))
    x1, x2 = clamp(F.array_min(at(0)), width), clamp(F.array_max(at(0)), width)
    y1, y2 = clamp(F.array_min(at(1)), height), clamp(F.array_max(at(1)), height)
    return F.struct(rounded(x1 / width, 4).alias("x"), rounded(y1 / height, 4).alias("y"), rounded((x2 - x1) / width, 4).alias("w"), rounded((y2 - y1) / height, 4).alias("h"))


def cells(tables: DataFrame) -> DataFrame:
    """One row a cell of tables (``table_id, html, boxes, logic, page_w, page_h``): the three lists go together as far as the shortest."""
    # texts are a column of their own: a generator works out each mention of an expression anew
    read = tables.select("table_id", "page_w", "page_h", "boxes", "logic", cell_texts(F.col("html")).alias("_texts"))
    n = F.least(F.size("_texts"), F.size("boxes"), F.size("logic"))
    zipped = F.arrays_zip(F.slice("_texts", 1, n).alias("text"), F.slice("boxes", 1, n).alias("box"), F.slice("logic", 1, n).alias("logic"))
    rows = read.select("table_id", "page_w", "page_h", F.posexplode(zipped).alias("ord", "c"))
    box = normal_box(F.col("c.box"), F.col("page_w"), F.col("page_h"))
    logic = [F.col("c.logic")[i].cast("int").alias(k) for i, k in enumerate(("row", "row_end", "col", "col_end"))]
    return rows.select("table_id", "ord", *logic, *(box[k].alias(k) for k in "xywh"), F.col("c.text").alias("text"))


def _rendered(cells_: pa.RecordBatch) -> pa.RecordBatch:
    """``table_id, md`` of whole tables, all at a time; each place of a grid is filled once."""

    def joined(texts: pa.Array, ends: np.ndarray, by: str) -> pa.Array:
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), texts), by)

    def whole(name: str, none: int) -> np.ndarray:
        return pc.fill_null(cells_.column(name), none).to_numpy().astype(np.int64)

    begins = whole("n", 0) == 1
    heads, table = np.flatnonzero(begins), np.cumsum(begins) - 1
    rows, cols = (np.maximum.reduceat(whole(c, -1), heads) + 1 for c in ("row_end", "col_end"))
    known = (rows > 0) & (cols > 0)
    rows, cols = np.where(known, rows, 0), np.where(known, cols, 0)
    row, col, texts = whole("row", -1), whole("col", -1), cells_.column("t")
    kept = (row >= 0) & (row < rows[table]) & (col >= 0) & (col < cols[table]) & texts.is_valid().to_numpy(zero_copy_only=False)
    table, row, col, texts = table[kept], row[kept], col[kept], texts.filter(pa.array(kept))
    place = (np.cumsum(rows * cols) - rows * cols)[table] + row * cols[table] + col
    first = np.flatnonzero(np.diff(place, prepend=-1))
    shared = pc.utf8_trim(joined(texts, np.append(first, len(place))[1:], " "), " ")
    grid = np.full((rows * cols).sum(), len(first))
    grid[place[first]] = np.arange(len(first))
    filled = pa.concat_arrays([shared, pa.array([""], shared.type)]).take(pa.array(grid))
    lines = pc.binary_join_element_wise("| ", joined(filled, np.cumsum(np.repeat(cols, rows)), " | "), " |", "")
    rules = pc.binary_join_element_wise("|", pc.binary_repeat("---|", pa.array(cols)), "")
    # a table's rule comes after its first line
    ends = np.cumsum(rows)
    order = np.insert(np.arange(len(lines)), np.minimum(ends - rows + 1, ends), len(lines) + np.arange(len(rows)))
    md = joined(pa.concat_arrays([lines, rules]).take(pa.array(order)), np.cumsum(rows + 1), "\n")
    return pa.RecordBatch.from_arrays([cells_.column("table_id").take(pa.array(heads)), pc.if_else(pa.array(known), md, pa.scalar(None, md.type))], names=["table_id", "md"])


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``table_id, md`` of cells in order of their tables, of which ``n`` 1 is the first; the last table of a batch may go on in the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        begins = np.flatnonzero(batch.column("n").to_numpy() == 1)
        if not len(begins):
            held.append(batch)
            continue
        before = [*held, batch.slice(0, begins[-1])]
        if any(b.num_rows for b in before):
            yield _rendered(pa.concat_batches(before))
        held = [batch.slice(begins[-1])]
    if any(b.num_rows for b in held):
        yield _rendered(pa.concat_batches(held))


def markdown(cells_: DataFrame) -> DataFrame:
    """``table_id, md``: cells at their first row and column, those that share it joined in order; row 0 is the head.

    A table without a row or column has no Markdown.  Cells go to Python sorted within
    their tables, many tables at a time.
    """
    marked = cells_.select("table_id", "ord", "row", "row_end", "col", "col_end", markdown_cell(F.col("text")).alias("t"))
    placed = marked.withColumn("n", F.row_number().over(Window.partitionBy("table_id").orderBy("row", "col", "ord", "t"))).drop("ord")
    return placed.mapInArrow(_written, f"table_id {cells_.schema['table_id'].dataType.simpleString()}, md string")


def elements(cells_: DataFrame, rotation: int = 0) -> DataFrame:
    """``table_id, jsonl``: a line on the table, then one for each cell in order."""
    cell = F.to_json(F.struct("row", "row_end", "col", "col_end", "x", "y", "w", "h", "text"))
    head = F.to_json(F.struct(F.lit(rotation).alias("rotation"), F.count("*").alias("cells")))
    body = F.transform(F.array_sort(F.collect_list(F.struct("ord", cell.alias("j")))), lambda x: x["j"])
    return cells_.groupBy("table_id").agg(F.array_join(F.concat(F.array(head), body), "\n").alias("jsonl"))


def regions(found: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Detections (``page_key, label, score, box, page_w, page_h``) of tables that are sure enough, best first within a page."""
    box = normal_box(F.col("box"), F.col("page_w"), F.col("page_h"))
    kept = found.where((F.col("label") == "table") & (F.col("score") >= least))
    return kept.select("page_key", *(box[k].alias(k) for k in "xywh"), "score").orderBy("page_key", F.desc("score"))
