"""Tables with drawn rules, from page images: rule lines, their grid, cells over several rows and columns.

Long runs of ink are rules, rules that touch are one table, and cells of the grid
between which no rule runs are one cell.  Pixels are read of netpbm images.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .images import dark

#: A rule is at least so many pixels long, and so large a share of the page's longer edge; and at most so thick.
SHORTEST, SHARE, THICKEST = 10, 0.02, 12
#: Rules that miss each other by no more pixels than this still touch, and lie on one border of the grid.
SLACK = 3
#: Pixels, and pages, that are worked out together; pairs of rules that are held against each other at a time.
PIXELS, HELD, PAIRS = 8 << 20, 1024, 1 << 20
#: A border is drawn between two cells if rules cover such a share of it.
COVERED = 0.5

_TABLES = "array<struct<html string, boxes array<array<double>>, logic array<array<int>>>>"


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each one's group, where each of ``a`` is joined with that of ``b``."""
    least = np.arange(n)
    while len(a):
        x, y = least[a], least[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(least, np.maximum(x, y), np.minimum(x, y))
        while (least != (further := least[least])).any():
            least = further
    return least


def groups(n: int, pairs: Iterable[tuple[int, int]]) -> list[int]:
    """The least member of each one's group, where ``pairs`` are joined."""
    a, b = np.array(list(pairs), np.int64).reshape(-1, 2).T
    return joined(n, a, b).tolist()


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All members of ranges of whole numbers, and the range of each."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum()), np.repeat(np.arange(len(sizes)), sizes)


class _Rules:
    """Horizontal rules of pages: ``page, place, start, end`` in this order; their middle row, and columns from start up to end."""

    def __init__(self, page: np.ndarray, place: np.ndarray, start: np.ndarray, end: np.ndarray):
        order = np.lexsort((end, start, place, page))
        self.page, self.place, self.start, self.end = page[order], place[order], start[order], end[order]


def rules(pages: list[np.ndarray], shortest: np.ndarray) -> _Rules:
    """Rules of all pages (dark pixels), of at least the ``shortest`` length of the page.

    Runs of dark pixels of neighbouring rows that overlap are one rule, unless
    they pile up to more than ``THICKEST`` rows, as a filled area does.
    """
    height, width = np.array([p.shape if p.size else (0, 0) for p in pages]).T
    wide = width + 1  # a row ends with a pixel that is not dark
    first = np.cumsum(height * wide) - height * wide
    inked = np.zeros(1 + int((height * wide).sum()), bool)
    for p, begin, h, w in zip(pages, (first + 1).tolist(), height.tolist(), width.tolist(), strict=True):
        if h:
            inked[begin : begin + h * (w + 1)].reshape(h, w + 1)[:, :w] = p
    edges = np.flatnonzero(inked[1:] != inked[:-1])
    at, ends = edges[0::2], edges[1::2]
    page = np.searchsorted(first + height * wide, at, side="right")
    long = ends - at >= shortest[page]
    at, size, page = at[long], (ends - at)[long], page[long]
    y, start = np.divmod(at - first[page], wide[page])
    end = start + size
    # rows of all pages one after the other, pages a row apart; runs stand in this order
    row, step = (np.cumsum(height) - height + np.arange(len(pages)))[page] + y, int(width.max()) + 2
    low = np.searchsorted(row * step + end, (row - 1) * step + start, side="right")
    high = np.searchsorted(row * step + start, (row - 1) * step + end, side="left")
    above, below = _ranges(low, np.maximum(high - low, 0))
    least = joined(len(row), above, below)
    order = np.argsort(least, kind="stable")
    if not len(order):
        return _Rules(page, y / 2, start, end)
    heads = np.flatnonzero(np.diff(least[order], prepend=-1))
    top, bottom = y[order[heads]], np.maximum.reduceat(y[order], heads)
    thin = bottom - top < THICKEST
    return _Rules(page[order[heads]][thin], (top + bottom)[thin] / 2, np.minimum.reduceat(start[order], heads)[thin], np.maximum.reduceat(end[order], heads)[thin])


def _touching(across: _Rules, down: _Rules) -> tuple[np.ndarray, np.ndarray]:
    """Which rules across touch which rules down, on the same page."""
    low, high = (np.searchsorted(down.page, across.page, side=side) for side in ("left", "right"))
    sizes = high - low
    found = []
    for some in np.split(np.arange(len(low)), np.flatnonzero(np.diff(np.cumsum(sizes) // PAIRS)) + 1):
        j, i = _ranges(low[some], sizes[some])
        i = some[i]
        x, y = down.place[j], across.place[i]
        touch = (across.start[i] - SLACK <= x) & (x <= across.end[i] + SLACK) & (down.start[j] - SLACK <= y) & (y <= down.end[j] + SLACK)
        found.append((i[touch], j[touch]))
    i, j = zip(*found, strict=True)
    return np.concatenate(i), np.concatenate(j)


class _Borders:
    """Borders of tables in one direction: where rules lie; those within ``SLACK`` of the one before are one, at their mean place."""

    def __init__(self, n: int, table: np.ndarray, lines: _Rules):
        order = np.lexsort((lines.place, table))
        place, table = lines.place[order], table[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (np.diff(table) > 0) | (np.diff(place) > SLACK)
        heads = np.flatnonzero(fresh)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(fresh) - 1
        self.table, self.lines = table[heads], lines
        self.place = np.add.reduceat(place, heads) / np.diff(np.append(heads, len(place))) if len(heads) else place
        #: Of each table, its first border and their number.
        self.first = np.searchsorted(self.table, np.arange(n))
        self.n = np.searchsorted(self.table, np.arange(n), side="right") - self.first

    def covered(self, other: _Borders) -> tuple[np.ndarray, np.ndarray]:
        """Whether rules cover enough of each border between two neighbours of the ``other`` borders; and where those of a border begin."""
        parts = np.maximum(other.n[self.table] - 1, 0)
        begin = np.cumsum(parts) - parts
        # rules of a border as spans that do not overlap
        near = np.flatnonzero(np.abs(self.lines.place - self.place[self.of]) <= SLACK)
        near = near[np.lexsort((self.lines.end[near], self.lines.start[near], self.of[near]))]
        of, start, end = self.of[near], self.lines.start[near], self.lines.end[near]
        step = int(self.lines.end.max(initial=0)) + 1
        upto = np.maximum.accumulate(of * step + end)
        start = np.maximum(start, np.concatenate([[0], upto[:-1]]) - of * step)
        some = (start < end) & (parts[of] > 0)
        of, start, end = of[some], start[some], end[some]
        # each with the parts that it reaches, and one more at either end
        table = self.table[of]
        wide = float(max(step, other.lines.end.max(initial=0), other.place.max(initial=0)) + 1)
        places = other.table * wide + other.place
        low = np.maximum(np.searchsorted(places, table * wide + start) - other.first[table] - 2, 0)
        high = np.minimum(np.searchsorted(places, table * wide + end) - other.first[table] + 1, parts[of])
        part, span = _ranges(low, np.maximum(high - low, 0))
        left = other.first[table[span]] + part
        reached = np.minimum(end[span], other.place[left + 1]) - np.maximum(start[span], other.place[left])
        total = np.bincount(begin[of[span]] + part, np.maximum(reached, 0), int(parts.sum()))
        part, border = _ranges(np.zeros(len(parts), np.int64), parts)
        left = other.first[self.table[border]] + part
        return total >= COVERED * (other.place[left + 1] - other.place[left]), begin


class Cells:
    """Cells of tables, by table, row and column.

    ``logic`` is ``row, row_end, col, col_end``, ends inclusive; ``corners`` are ``x1, y1, x2, y2``.
    Cells of the grid that open into each other are one, if they make up a rectangle; if not, each stays by itself.
    """

    def __init__(self, n: int, across: _Rules, of_across: np.ndarray, down: _Rules, of_down: np.ndarray):
        ys, xs = _Borders(n, of_across, across), _Borders(n, of_down, down)
        rows, cols = np.maximum(ys.n - 1, 0), np.maximum(xs.n - 1, 0)
        i, table = _ranges(np.zeros(n, np.int64), rows * cols)
        r, c = np.divmod(i, cols[table])
        right, below = np.flatnonzero(c < cols[table] - 1), np.flatnonzero(r < rows[table] - 1)
        ruled_right, begin = xs.covered(ys)
        right = right[~ruled_right[begin[xs.first[table[right]] + c[right] + 1] + r[right]]]
        ruled_below, begin = ys.covered(xs)
        below = below[~ruled_below[begin[ys.first[table[below]] + r[below] + 1] + c[below]]]
        least = joined(len(i), np.concatenate([right, below]), np.concatenate([right + 1, below + cols[table[below]]]))
        order = np.argsort(least, kind="stable")
        heads = np.flatnonzero(np.diff(least[order], prepend=-1))
        sizes = np.diff(np.append(heads, len(order)))
        if len(heads):
            spans = np.array([f.reduceat(x[order], heads) for f, x in ((np.minimum, r), (np.maximum, r), (np.minimum, c), (np.maximum, c))])
            whole = sizes == (spans[1] - spans[0] + 1) * (spans[3] - spans[2] + 1)
            alone = order[np.repeat(~whole, sizes)]
            spans = np.concatenate([spans[:, whole], [r[alone], r[alone], c[alone], c[alone]]], axis=1)
            table = np.concatenate([table[order[heads[whole]]], table[alone]])
        else:
            spans = np.zeros((4, 0), np.int64)
        order = np.lexsort((spans[2], spans[0], table))
        self.table, (r1, r2, c1, c2) = table[order], spans[:, order]
        y, x = ys.first[self.table], xs.first[self.table]
        self.logic = np.stack([r1, r2, c1, c2], axis=1).astype(np.int32)
        self.corners = np.stack([xs.place[x + c1], ys.place[y + r1], xs.place[x + c2 + 1], ys.place[y + r2 + 1]], axis=1)

    def listed(self) -> list[tuple[tuple[int, int, int, int], tuple[float, float, float, float]]]:
        return list(zip(map(tuple, self.logic.tolist()), map(tuple, self.corners.tolist()), strict=True))


def grid_cells(across: list[tuple[float, int, int]], down: list[tuple[float, int, int]]) -> list[tuple[tuple[int, int, int, int], tuple[float, float, float, float]]]:
    """``(row, row_end, col, col_end), (x1, y1, x2, y2)`` of one table's cells, from its rules ``place, start, end``."""
    lines = [_Rules(np.zeros(len(x), np.int64), *np.array(x, np.float64).reshape(-1, 3).T) for x in (across, down)]
    return Cells(1, lines[0], lines[0].page, lines[1], lines[1].page).listed()


def tables_in(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, Cells]:
    """Tables of pages of dark pixels: of each page their number, of each table the number of its cells, and the cells; tables by page, top and left."""
    shortest = np.array([max(SHORTEST, round(SHARE * max(p.shape))) for p in pages], np.int64)
    across, down = rules(pages, shortest), rules([p.T for p in pages], shortest)
    i, j = _touching(across, down)
    n = len(across.page)
    least, table = np.unique(joined(n + len(down.page), i, n + j), return_inverse=True)
    cells = Cells(len(least), across, table[:n], down, table[n:])
    heads = np.flatnonzero(np.diff(cells.table, prepend=-1))
    sizes, page = np.diff(np.append(heads, len(cells.table))), np.concatenate([across.page, down.page])[least[cells.table[heads]]]
    order = np.lexsort((cells.corners[heads, 0], cells.corners[heads, 1], page))
    moved, _ = _ranges(heads[order], sizes[order])
    cells.table, cells.logic, cells.corners = cells.table[moved], cells.logic[moved], cells.corners[moved]
    return np.bincount(page, minlength=len(pages)), sizes[order], cells


def tables_of(content: bytes) -> list[list[tuple[tuple[int, int, int, int], tuple[float, float, float, float]]]] | None:
    """Cells of each table of a page, tables by their top and left; null where pixels cannot be read."""
    pixels = dark(content)
    if pixels is None:
        return None
    _, sizes, cells = tables_in([pixels])
    listed, ends = cells.listed(), np.cumsum(sizes).tolist()
    return [listed[a:b] for a, b in zip([0, *ends], ends)]


def _html(logic: list[tuple[int, int, int, int]]) -> str:
    rows: dict[int, list[str]] = {}
    for r1, r2, c1, c2 in logic:
        spans = (f' rowspan="{r2 - r1 + 1}"' if r2 > r1 else "") + (f' colspan="{c2 - c1 + 1}"' if c2 > c1 else "")
        rows.setdefault(r1, []).append(f"<td{spans}></td>")
    return "<table>" + "".join("<tr>" + "".join(rows[r]) + "</tr>" for r in sorted(rows)) + "</table>"


def _lists(sizes: np.ndarray | list[int], values: pa.Array, missing: list[bool] | None = None) -> pa.Array:
    offsets = np.cumsum([0, *sizes]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=None if missing is None else pa.array(missing, pa.bool_()))


def structure(image: Column) -> Column:
    """Tables of page images, for the slot of that name: ``html, boxes, logic`` of each.

    Cells are empty: what a page's text boxes say is put into them by ``filled``.
    Null images and those that cannot be read are null; pages without rules have no
    tables.  Pages are worked out together, some ``PIXELS`` at a time.
    """

    def run(image: pa.Array) -> pa.Array:
        missing, held, size, found = [], [], 0, []

        def work() -> None:
            per_page, per_table, cells = tables_in(held)
            logic, ends = list(map(tuple, cells.logic.tolist())), np.cumsum(per_table).tolist()
            htmls = [_html(logic[a:b]) for a, b in zip([0, *ends], ends)]
            x1, y1, x2, y2 = cells.corners.T
            found.append((per_page, per_table, htmls, cells.logic.ravel(), np.stack([x1, y1, x2, y1, x2, y2, x1, y2], axis=1).ravel()))

        for x in image:
            pixels = dark(x.as_py()) if x.is_valid else None
            missing.append(pixels is None)
            held.append(np.zeros((0, 0), bool) if pixels is None else pixels)
            size += held[-1].size
            if size >= PIXELS or len(held) >= HELD:
                work()
                held, size = [], 0
        if held or not found:
            held = held or [np.zeros((0, 0), bool)]
            work()
        per_page, per_table, logic, boxes = (np.concatenate([f[i] for f in found]) for i in (0, 1, 3, 4))
        n = int(per_table.sum())
        of_boxes = _lists(per_table, _lists([8] * n, pa.array(boxes)))
        of_logic = _lists(per_table, _lists([4] * n, pa.array(logic)))
        tables = pa.StructArray.from_arrays([pa.array([h for f in found for h in f[2]], pa.string()), of_boxes, of_logic], ["html", "boxes", "logic"])
        return _lists(per_page[: len(missing)], tables, missing)

    run.__annotations__ = {"image": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, _TABLES)(image)


def page_tables(pages: DataFrame, key: str = "page_key", read=structure) -> DataFrame:
    """``table_id, page_key, html, boxes, logic`` of pages (``key``, ``image``): tables numbered from 0 within a page.

    Repeated pages give repeated tables; a page without tables gives none.
    """
    found = pages.select(F.col(key).alias("page_key"), F.posexplode(read(F.col("image"))).alias("n", "t"))
    return found.select(F.concat_ws("#", "page_key", "n").alias("table_id"), "page_key", "t.*")


def filled(cells: DataFrame, words: DataFrame) -> DataFrame:
    """``cells`` (``page_key, x, y, w, h, text``, and others) with the text of a page's ``words`` (``page_key, x, y, w, h, text``).

    A word belongs to the cell that holds its middle, the left and upper border
    included; words are put together from top to bottom, then from left to right.
    A cell without words keeps its text.  Coordinates of both are of one kind.
    """
    c, w = cells.alias("c"), words.where(F.trim("text") != "").alias("w")
    mx, my = F.col("w.x") + F.col("w.w") / 2, F.col("w.y") + F.col("w.h") / 2
    inside = (mx >= F.col("c.x")) & (mx < F.col("c.x") + F.col("c.w")) & (my >= F.col("c.y")) & (my < F.col("c.y") + F.col("c.h"))
    met = c.join(w, (F.col("c.page_key") == F.col("w.page_key")) & inside, "left")
    said = F.array_sort(F.collect_list(F.when(F.col("w.text").isNotNull(), F.struct(my.alias("y"), mx.alias("x"), F.col("w.text").alias("t")))))
    others = [k for k in cells.columns if k != "text"]
    out = met.groupBy(*(F.col(f"c.{k}") for k in cells.columns)).agg(said.alias("said"))
    return out.select(*others, F.when(F.size("said") > 0, F.array_join(F.transform("said", lambda s: s["t"]), " ")).otherwise(F.col("text")).alias("text"))
