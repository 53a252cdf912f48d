"""Tables drawn with merged cells come back as they were drawn."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrule.operators import ruled, tables


def pgm(levels):
    return b"P5\n%d %d\n255\n" % (levels.shape[1], levels.shape[0]) + levels.astype(np.uint8).tobytes()


def drawn(spans, xs, ys, thick=2, page=None):
    """A page with the outlines of cells ``row, row_end, col, col_end``."""
    page = np.full((ys[-1] + 15, xs[-1] + 15), 255) if page is None else page
    for r1, r2, c1, c2 in spans:
        x1, x2, y1, y2 = xs[c1], xs[c2 + 1], ys[r1], ys[r2 + 1]
        for y in (y1, y2):
            page[y : y + thick, x1 : x2 + thick] = 0
        for x in (x1, x2):
            page[y1 : y2 + thick, x : x + thick] = 0
    return page


@st.composite
def layouts(draw):
    """A grid with some rectangles of it merged, each border of the grid still drawn somewhere."""
    rows, cols = draw(st.integers(1, 5)), draw(st.integers(1, 5))
    free, spans = {(r, c) for r in range(rows) for c in range(cols)}, []
    for r in range(rows):
        for c in range(cols):
            if (r, c) in free:
                h, w = draw(st.integers(1, 3)), draw(st.integers(1, 3))
                block = [(a, b) for a in range(r, min(r + h, rows)) for b in range(c, min(c + w, cols))]
                if not set(block) <= free or (0 in (r, c)):  # the first row and column show all borders
                    block = [(r, c)]
                free -= set(block)
                spans.append((r, max(a for a, _ in block), c, max(b for _, b in block)))
    sizes = st.integers(14, 40)
    xs = np.cumsum([8] + [draw(sizes) for _ in range(cols)]).tolist()
    ys = np.cumsum([8] + [draw(sizes) for _ in range(rows)]).tolist()
    return spans, xs, ys, draw(st.integers(1, 4))


@settings(max_examples=150, deadline=None)
@given(layouts())
def test_merged_cells_come_back(layout):
    spans, xs, ys, thick = layout
    (cells,) = ruled.tables_of(pgm(drawn(spans, xs, ys, thick)))
    off = (thick - 1) / 2
    assert cells == [((r1, r2, c1, c2), (xs[c1] + off, ys[r1] + off, xs[c2 + 1] + off, ys[r2 + 1] + off)) for r1, r2, c1, c2 in sorted(spans, key=lambda s: (s[0], s[2]))]


def test_pages():
    """Two tables, text, a filled area and a lone rule; blank, tiny and unreadable pages."""
    page = np.full((300, 300), 255)
    drawn([(0, 0, 0, 0), (0, 0, 1, 1)], [10, 60, 120], [10, 40], page=page)
    drawn([(0, 0, 0, 1), (1, 1, 0, 0), (1, 1, 1, 1)], [150, 200, 260], [100, 130, 170], page=page)
    page[20:24, 20:24] = 0  # text
    page[200:260, 20:100] = 0  # a filled area
    page[280, 20:200] = 0  # a rule alone
    one, two = ruled.tables_of(pgm(page))
    assert [logic for logic, _ in one] == [(0, 0, 0, 0), (0, 0, 1, 1)] and [logic for logic, _ in two] == [(0, 0, 0, 1), (1, 1, 0, 0), (1, 1, 1, 1)]
    assert ruled.tables_of(pgm(np.full((50, 50), 255))) == [] == ruled.tables_of(pgm(np.zeros((50, 50)))) == ruled.tables_of(pgm(np.zeros((1, 1))))
    assert ruled.tables_of(b"x") is None and ruled.tables_of(b"P5\n0 0\n255\n") == []


def test_cells_that_make_no_rectangle_stay_apart():
    across = [(0.0, 0, 61), (30.0, 30, 61), (60.0, 0, 61)]
    down = [(0.0, 0, 61), (30.0, 30, 61), (60.0, 0, 61)]  # three of four cells open into each other
    assert [logic for logic, _ in ruled.grid_cells(across, down)] == [(0, 0, 0, 0), (0, 0, 1, 1), (1, 1, 0, 0), (1, 1, 1, 1)]


def test_through_cells_to_markdown(spark):
    page = drawn([(0, 0, 0, 1), (1, 1, 0, 0), (1, 1, 1, 1)], [10, 60, 120], [10, 40, 80])
    h, w = page.shape
    rows = [("p", bytearray(pgm(page)), "extra"), ("null", None, ""), ("bad", bytearray(b"x"), ""), ("blank", bytearray(pgm(np.full((9, 9), 255))), "")]
    found = ruled.page_tables(spark.createDataFrame(rows, "page_key string, image binary, html string"))
    assert [(r["table_id"], r["html"]) for r in found.collect()] == [("p#0", '<table><tr><td colspan="2"></td></tr><tr><td></td><td></td></tr></table>')]
    from pyspark.sql import functions as F

    cells = tables.cells(found.withColumns({"page_w": F.lit(w), "page_h": F.lit(h)})).withColumn("page_key", F.lit("p"))
    words = [("p", "b", 30, 50), ("p", "a", 20, 50), ("p", "Head", 50, 20), ("p", "|", 90, 60), ("q", "no", 20, 20), ("p", "out", 130, 5), ("p", None, 20, 20)]
    words = spark.createDataFrame([(k, t, x / w, y / h, 0.01, 0.01) for k, t, x, y in words], "page_key string, text string, x double, y double, w double, h double")
    md = tables.markdown(ruled.filled(cells, words)).first()["md"]
    assert md == "| Head |  |\n|---|---|\n| a b | \\| |"


@pytest.mark.parametrize("n, pairs, want", [(0, [], []), (4, [(3, 1), (1, 3)], [0, 1, 2, 1]), (5, [(4, 3), (3, 2), (0, 1)], [0, 0, 2, 2, 2])])
def test_groups(n, pairs, want):
    assert ruled.groups(n, pairs) == want


def test_pages_together_are_as_pages_alone():
    """Many pages are worked out in a few passes, however they differ in size; none takes anything from its neighbour."""
    rng, pages = np.random.default_rng(3), [np.zeros((0, 0)), np.full((9, 9), 255)]
    for _ in range(300):
        h, w = rng.integers(1, 150, 2)
        page = np.full((h, w), 255)
        for y, x, size, thick in zip(rng.integers(0, h, 9), rng.integers(0, w, 9), rng.integers(5, 150, 9), rng.integers(1, 5, 9), strict=True):
            page[(slice(y, y + thick), slice(x, x + size)) if size % 2 else (slice(y, y + size), slice(x, x + thick))] = 0
        pages += [page, drawn([(0, 0, 0, 1), (1, 1, 0, 0), (1, 1, 1, 1)], [4, 34, 64], [4, 24, 24 + int(h)])]
    n, sizes, cells = ruled.tables_in([p < 180 for p in pages])
    alone = [ruled.tables_of(pgm(p)) for p in pages]
    assert n.tolist() == [len(t) for t in alone] and n[0] == n[1] == 0
    assert sizes.tolist() == [len(c) for t in alone for c in t]
    assert cells.listed() == [c for t in alone for table in t for c in table]


def test_a_batch_takes_few_passes(monkeypatch):
    calls = []
    monkeypatch.setattr(ruled, "tables_in", lambda pages, real=ruled.tables_in: calls.append(len(pages)) or real(pages))
    monkeypatch.setattr(ruled.F, "arrow_udf", lambda f, _: lambda _: f)
    import pyarrow as pa

    page = pgm(drawn([(0, 0, 0, 0)], [4, 40], [4, 40]))
    got = ruled.structure(None)(pa.array([page, None, b"x"] * 500))
    assert calls == [1024, 476] and got.null_count == 1000 and got[0].as_py() == got[1497].as_py() and len(got[0]) == 1
