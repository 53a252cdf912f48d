"""Inputs that several queries derive from the standard tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.sources.tables import table

_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]


def order_lines(spark, d: str) -> DataFrame:
    """Order lines with ``n``, their number within the order: the line numbers of the table repeat."""
    return table(spark, d, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_ORDER)))


ORDER_LINES = f"li AS (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS INTEGER) AS n FROM lineitem)"


#: Where the columns of a drawn table begin and the last one ends; where its rows begin; the height of its first and last row.
DRAWN_COLUMNS, DRAWN_TOP, DRAWN_ROW = (4, 30, 60, 90), 4, 14


def _row(*spans: tuple[int, int]) -> bytes:
    """A row of pixels that is dark from the start of each span up to its end."""
    row = np.full(DRAWN_COLUMNS[-1] + 6, 255, np.uint8)
    for a, b in spans:
        row[a:b] = 0
    return row.tobytes()


def _columns(*which: int) -> bytes:
    return _row(*((DRAWN_COLUMNS[i], DRAWN_COLUMNS[i] + 2) for i in which))


#: All rows of pixels that a drawn table has.
_ROWS = {"blank": _row(), "rule": _row((DRAWN_COLUMNS[0], DRAWN_COLUMNS[-1] + 2)), "head": _columns(0, 3), "wide": _columns(0, 1, 3), "plain": _columns(0, 1, 2, 3)}


def drawn_table(heights: list[int], wide: list[bool]) -> bytes:
    """An image of a table: a head over all columns, a row of each height, and a foot; rows that are wide have no rule before their last column."""
    bands = [(DRAWN_ROW, _ROWS["head"]), *((h, _ROWS["wide" if w else "plain"]) for h, w in zip(heights, wide, strict=True)), (DRAWN_ROW, _ROWS["plain"])]
    rule, blank = _ROWS["rule"], _ROWS["blank"]
    body = b"".join([blank * DRAWN_TOP, *(rule * 2 + row * (h - 2) for h, row in bands), rule * 2, blank * 4])
    return b"P5\n%d %d\n255\n" % (len(blank), len(body) // len(blank)) + body


def drawn(tables: DataFrame) -> DataFrame:
    """``key, image`` of tables to draw (``key`` long, ``heights, wide``); images leave a task some hundred at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256).to_pydict()
                images = [drawn_table(h, w) for h, w in zip(rows["heights"], rows["wide"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows["key"], pa.int64()), pa.array(images, pa.binary())], ["key", "image"])

    return tables.select("key", "heights", "wide").mapInArrow(run, "key long, image binary")
