"""Layout of a page's text boxes: lines, strips, columns, reading order.

Boxes are rows ``page_key, box_idx, x0, y0, x1, y1`` (and ``txt`` where text is
assembled).  All is windows over a page and one fold; a page's boxes are the
largest group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values, as shares of the page's width or height.
COLUMN_GAP, STRIP_GAP, SHRINK = 0.01, 0.01, 0.005
#: A split is refused if a column would have fewer boxes.
LEAST_BOXES = 2


def rect_of(quad: Column) -> Column:
    """The upright rectangle around a quad ``[[x, y] * 4]``."""
    xs, ys = F.transform(quad, lambda p: p[0]), F.transform(quad, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def spans(boxes: DataFrame, by: list[str], low: Column, high: Column, gap: Column, name: str) -> DataFrame:
    """Number the islands of intervals: a new one begins where the gap to all before is at least ``gap``."""
    order = Window.partitionBy(*by).orderBy("_lo", "_hi", "box_idx")
    marked = boxes.withColumns({"_lo": low, "_hi": high}).withColumn("_far", F.max("_hi").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = F.when(F.col("_far").isNull() | (F.col("_lo") - F.col("_far") >= gap), 1).otherwise(0)
    return marked.withColumn("_new", fresh).withColumn(name, F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_lo", "_hi", "_far", "_new")


def strips(boxes: DataFrame, height: float) -> DataFrame:
    return spans(boxes, ["page_key"], F.col("y0"), F.col("y1"), F.lit(STRIP_GAP * height), "strip")


def columns(boxes: DataFrame, width: float, by: tuple[str, ...] = ("page_key",), least: int = 1) -> DataFrame:
    """``col`` within each group; all 0 where a column has fewer than ``least`` boxes."""
    inset = SHRINK * width
    narrow = F.col("x1") - inset < F.col("x0") + inset
    centre = (F.col("x0") + F.col("x1")) / 2
    low, high = F.when(narrow, centre).otherwise(F.col("x0") + inset), F.when(narrow, centre).otherwise(F.col("x1") - inset)
    out = spans(boxes, list(by), low, high, F.lit(COLUMN_GAP * width), "col")
    if least > 1:
        size = F.count("*").over(Window.partitionBy(*by, "col"))
        fewest = F.min("_size").over(Window.partitionBy(*by))
        out = out.withColumn("_size", size).withColumn("col", F.when(fewest < least, 0).otherwise(F.col("col"))).drop("_size")
    return out


def lines(boxes: DataFrame, by: tuple[str, ...] = ("page_key",)) -> DataFrame:
    """``line`` within each group: a box opens one if its top is over half its height below the top of the line's first box."""
    box = F.struct("y0", "x0", "box_idx", "y1")
    grouped = boxes.groupBy(*by).agg(F.array_sort(F.collect_list(box)).alias("_boxes"))
    start = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("line"), F.array().cast("array<struct<box_idx:bigint,line:int>>").alias("done"))

    def step(acc: Column, b: Column) -> Column:
        opens = acc["anchor"].isNull() | (b["y0"] - acc["anchor"] > 0.5 * F.greatest(b["y1"] - b["y0"], F.lit(1.0)))
        line = acc["line"] + F.when(opens, 1).otherwise(0)
        done = F.concat(acc["done"], F.array(F.struct(b["box_idx"].cast("bigint").alias("box_idx"), line.alias("line"))))
        return F.struct(F.when(opens, b["y0"]).otherwise(acc["anchor"]).alias("anchor"), line.alias("line"), done.alias("done"))

    numbered = grouped.select(*by, F.explode(F.aggregate("_boxes", start, step, lambda a: a["done"])).alias("_l")).select(*by, "_l.box_idx", "_l.line")
    return boxes.join(numbered, [*by, "box_idx"])


def reading_order(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """``boxes`` with ``line, place`` as read across the page, and ``strip, col, region_line, region_place`` as read by regions."""
    plain = lines(boxes)
    plain = plain.withColumn("place", F.row_number().over(Window.partitionBy("page_key").orderBy("line", "x0", "box_idx")) - 1)
    group = ("page_key", "strip", "col")
    regions = lines(columns(strips(boxes, height), width, ("page_key", "strip"), LEAST_BOXES), group)
    place = F.row_number().over(Window.partitionBy("page_key").orderBy("strip", "col", "line", "x0", "box_idx")) - 1
    regions = regions.select("page_key", "box_idx", "strip", "col", F.col("line").alias("region_line"), place.alias("region_place"))
    return plain.join(regions, ["page_key", "box_idx"])


def _joined(boxes: Column, line: list[str]) -> Column:
    """The text of a page's ``boxes``, which stand by ``line``; those without text add nothing to theirs."""
    new = lambda b, i: ~reduce(Column.__and__, [b[k].eqNullSafe(F.get("_b", i - 1)[k]) for k in line])
    gap = lambda b, i: F.when(i == 0, "").when(new(b, i), "\n").when(b["txt"].isNull(), "").otherwise(" ")
    return F.array_join(F.transform(boxes, lambda b, i: F.concat(gap(b, i), F.coalesce(b["txt"], F.lit("")))), "")


def _by(line: list[str]) -> Callable[[Column], Column]:
    """A box as it stands in its line: boxes without text come last."""
    return lambda b: F.struct(*(b[k].alias(k) for k in line), b["txt"].isNull().alias("_none"), *(b[k].alias(k) for k in ("x0", "box_idx", "txt")))


def page_texts(ordered: DataFrame, **lines: list[str]) -> DataFrame:
    """``page_key`` and a text for each of ``lines`` (what tells a line, in order): all from one gathering of a page's boxes."""
    fields = [*dict.fromkeys(k for line in lines.values() for k in line), "x0", "box_idx", "txt"]
    out = ordered.groupBy("page_key").agg(F.collect_list(F.struct(*fields)).alias("_all"))
    for name, line in lines.items():
        out = out.withColumn("_b", F.array_sort(F.transform("_all", _by(line)))).withColumn(name, _joined(F.col("_b"), line))
    return out.select("page_key", *lines)


#: What tells a line, as read across the page and by regions.
PLAIN, BY_REGION = ["line"], ["strip", "col", "region_line"]


def page_text(ordered: DataFrame, regions: bool = False) -> DataFrame:
    """``page_key, text``: boxes joined by blanks within lines, lines by line ends, in reading order."""
    return page_texts(ordered, text=BY_REGION if regions else PLAIN)


def discordance(places: Column) -> Column:
    """The share of pairs that stand the other way round; 0 under two."""
    n = F.size(places)
    pairs = F.aggregate(F.transform(places, lambda x, i: F.size(F.filter(F.slice(places, i + 2, F.greatest(n, F.lit(1))), lambda y: y < x))), F.lit(0), lambda a, x: a + x)
    return F.when(n < 2, 0.0).otherwise(pairs / (n * (n - 1) / 2))


def page_geometry(boxes: DataFrame, width: float, height: float) -> DataFrame:
    """``page_key, n_columns, max_band_gap, box_coverage, order_divergence, geometry_version`` of each page with boxes."""
    ordered = reading_order(boxes, width, height)
    gap = F.lead("x0").over(Window.partitionBy("page_key", "line").orderBy("x0", "box_idx")) - F.col("x1")
    gaps = ordered.withColumn("gap", F.greatest(gap, F.when(gap.isNotNull(), 0.0)))
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    order = F.transform(F.array_sort(F.collect_list(F.struct("place", "region_place"))), lambda x: x["region_place"])
    per_page = gaps.groupBy("page_key").agg((F.max("gap") / width).alias("max_band_gap"), (F.sum(area) / (width * height)).alias("box_coverage"), order.alias("_order"))
    n = columns(boxes, width).groupBy("page_key").agg((F.max("col") + 1).alias("n_columns"))
    return per_page.join(n, "page_key").select("page_key", "n_columns", "max_band_gap", "box_coverage", discordance(F.col("_order")).alias("order_divergence"), F.lit(1).alias("geometry_version"))


def in_regions(items: DataFrame, regions: DataFrame) -> DataFrame:
    """The items (``page_key, x, y, w, h``) whose centre lies in a region of their page, edges included."""
    r = regions.select(F.col("page_key").alias("_page"), *(F.col(c).alias(f"_{c}") for c in "xywh"))
    cx, cy = F.col("x") + F.col("w") / 2, F.col("y") + F.col("h") / 2
    inside = cx.between(F.col("_x"), F.col("_x") + F.col("_w")) & cy.between(F.col("_y"), F.col("_y") + F.col("_h"))
    return items.join(r, (F.col("page_key") == F.col("_page")) & inside, "left_semi")
