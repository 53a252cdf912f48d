"""Markdown of tables against a plain rendering, and of a table with many cells."""

import random
import time

from ferrule.operators import tables

SCHEMA = "table_id string, ord int, row int, row_end int, col int, col_end int, text string"


def plain(cells):
    """A table's Markdown, cell by cell."""
    rows = max((c[1] for c in cells if c[1] is not None), default=-1) + 1
    cols = max((c[3] for c in cells if c[3] is not None), default=-1) + 1
    if rows < 1 or cols < 1:
        return None
    at = lambda r, c: " ".join(x[4].replace("|", "\\|") for x in cells if (x[0], x[2]) == (r, c) and x[4] is not None).strip(" ")
    lines = ["| " + " | ".join(at(r, c) for c in range(cols)) + " |" for r in range(rows)]
    return "\n".join([lines[0], "|" + "---|" * cols, *lines[1:]])


def test_against_plain_rendering(spark):
    draw, found = random.Random(5), {}
    for t in range(120):
        rows, cols, cells = draw.randint(1, 6), draw.randint(1, 5), []
        for _ in range(draw.randint(1, 30)):
            r, c = (None if draw.random() < 0.05 else draw.randint(-1, most) for most in (rows, cols))
            cells.append((r, None if draw.random() < 0.1 else (r or 0) + draw.randint(-1, 1), c, None if draw.random() < 0.1 else (c or 0) + draw.randint(-1, 1), draw.choice([None, "", " ", "a|b", " x ", "é\n", "y"])))
        found[f"t{t}"] = cells
    rows = [(t, i, *c) for t, cells in found.items() for i, c in enumerate(cells)]
    draw.shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # tables go on in the next batch
    try:
        got = {r["table_id"]: r["md"] for r in tables.markdown(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {t: plain(cells) for t, cells in found.items()}
    assert not tables.markdown(spark.createDataFrame([], SCHEMA)).collect()


def test_table_of_many_cells(spark):
    """Twice the rows are twice the work: a place is not searched for among all cells."""
    size = 300
    cells = spark.range(size * size).selectExpr("'t' AS table_id", "CAST(id AS int) AS ord", f"CAST(id DIV {size} AS int) AS row", f"CAST(id DIV {size} AS int) AS row_end", f"CAST(id % {size} AS int) AS col", f"CAST(id % {size} AS int) AS col_end", "CAST(id AS string) AS text")
    begun = time.monotonic()
    md = tables.markdown(cells).first()["md"]
    assert time.monotonic() - begun < 20
    lines = md.split("\n")
    assert len(lines) == size + 1 and lines[-1] == "| " + " | ".join(str(i) for i in range(size * (size - 1), size * size)) + " |"
