"""Resumable batches under a budget."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrule.sources.scratch import materialise

PROGRESS = "file string, page int, status string, error_msg string, text string, cost_usd double"
#: Pages whose contents are stored for waves to come, at first and at most; seconds that one task reads alone.
AHEAD, MOST_AHEAD, ALONE = 1024, 65_536, 10.0


def done(checkpoint: DataFrame) -> DataFrame:
    """The pages that a checkpoint says are done or need not be."""
    return checkpoint.where(F.col("status").isin("done", "skipped_cached")).select("file", "page").distinct()


def work_list(files: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """``file, page`` still to do of ``files`` (``file, n_pages``)."""
    pages = files.where("n_pages > 0").select("file", F.explode(F.sequence(F.lit(1), F.col("n_pages").cast("int"))).alias("page"))
    return pages.join(done(checkpoint), ["file", "page"], "left_anti")


def within_budget(work: DataFrame, cap: float, by: str = "lane", order: tuple[str, ...] = ("seq",)) -> DataFrame:
    """The rows that are started before a lane's spending reaches its cap (``cost_usd``); what is in flight ends.

    A lane is one queue with its own budget, so that the running sum is over a
    lane and not over the table.
    """
    spent = F.coalesce(F.sum(F.round(F.col("cost_usd") * 1_000_000).cast("long")).over(Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return work.withColumn("spent_before", spent / 1_000_000.0).where(F.col("spent_before") < cap)


def within_run_budget(work: DataFrame, cap: float, order: tuple[str, ...] = ("file", "page")) -> DataFrame:
    """The rows that are started before the whole run's spending (``cost_usd``) reaches its one cap, in ``order``.

    The running sum goes over ranges of the order: each range is summed, the
    ranges' offsets are added to running sums within them, so that no task holds
    all rows.
    """
    micro = F.round(F.col("cost_usd") * 1_000_000).cast("long")
    dealt = materialise(work.withColumn("_micro", micro).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "budget")
    sums = dealt.groupBy("_range").agg(F.sum("_micro").alias("_sum"))  # a row a range
    offsets = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    earlier = F.sum("_micro").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = dealt.withColumn("_earlier", F.coalesce(earlier, F.lit(0))).join(F.broadcast(offsets), "_range")
    spent = (F.col("_offset") + F.col("_earlier")) / 1_000_000.0
    return rows.withColumn("spent_before", spent).where(F.col("spent_before") < cap).select(*work.columns, "spent_before")


class BudgetExceeded(RuntimeError):
    """A run has spent its cap with pages left to read; ``progress`` is what it did, stored."""

    def __init__(self, spent: float, cap: float, progress: DataFrame):
        super().__init__(f"${spent:.4f} spent of a budget of ${cap:.4f}, with pages left; run again to go on")
        self.spent, self.cap, self.progress = spent, cap, progress


def run_pages(pages: DataFrame, read: Callable[[bytes], str | tuple[str, float]], cost: float = 0.0, keep: tuple[str, ...] = ()) -> DataFrame:
    """``PROGRESS`` of ``pages`` (``file, page, content``) that ``read`` has gone over, a page at a time within Arrow batches; the columns ``keep`` go along.

    A page that fails is a row of status ``error`` and costs nothing; one that is
    read costs what ``read`` says beside its text, or else ``cost`` if it has text.
    As many pages are in flight as there are tasks.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_read_page(read, cost, *p) for p in zip(batch["file"], batch["page"], batch["content"], strict=True)]
            yield pd.concat([pd.DataFrame(rows, columns=_COLUMNS, index=batch.index), batch[list(keep)]], axis=1)

    return _contents(pages, keep).mapInPandas(run, PROGRESS + _kinds(pages, keep))


def run_until(pages: DataFrame, read: Callable[[bytes], str | tuple[str, float]], cost: float, left: int, seconds: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """``run_pages`` in order of ``seq``, one page after the other, until ``left`` millionths are spent or the time is up; later pages are no rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spent, end = 0, time.monotonic() + seconds
        for batch in batches:  # to the end, whatever is read
            rows = []
            for p in zip(batch["file"], batch["page"], batch["content"], strict=True):
                if spent >= left or time.monotonic() > end:
                    spent = left
                    break
                rows.append(_read_page(read, cost, *p))
                spent += round(rows[-1][-1] * 1_000_000)
            yield pd.concat([pd.DataFrame(rows, columns=_COLUMNS, index=batch.index[: len(rows)]), batch[list(keep)][: len(rows)]], axis=1)

    return _contents(pages.coalesce(1).sortWithinPartitions("seq"), keep).mapInPandas(run, PROGRESS + _kinds(pages, keep))


_COLUMNS = [f.split()[0] for f in PROGRESS.split(", ")]


def _contents(pages: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    return pages.select("file", F.col("page").cast("int").alias("page"), F.col("content").cast("binary").alias("content"), *keep)


def _kinds(pages: DataFrame, keep: tuple[str, ...]) -> str:
    return "".join(f", `{c}` {pages.schema[c].dataType.simpleString()}" for c in keep)


def _read_page(read: Callable[[bytes], str | tuple[str, float]], cost: float, file: str, page: int, content: bytes | None) -> tuple:
    try:
        found = read(None if content is None else bytes(content))
        text, spent = found if isinstance(found, tuple) else (found, cost if (found or "").strip() else 0.0)
        return file, page, "done", None, text, float(spent)
    except Exception as e:  # one page must not fail the run
        return file, page, "error", f"{type(e).__name__}: {e}", None, 0.0


def in_order(work: DataFrame, order: tuple[str, ...] = ("file", "page")) -> DataFrame:
    """``work`` (narrow rows) with ``seq``, their number from 0 on in ``order``, stored; ranges are counted apart and added up."""
    dealt = materialise(work.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "work")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row a range
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return materialise(dealt.withColumn("_in", place).join(before, "_range").select(*work.columns, (F.col("_in") + F.col("_before")).alias("seq")), "work-order")


def run_batch(pages: DataFrame, checkpoint: DataFrame, cache: DataFrame, read: Callable[[bytes], str | tuple[str, float]], cost: float, cap: float, in_flight: int = 1) -> DataFrame:
    """A resumable run over ``pages`` (``file, page, content``): ``PROGRESS`` with the content's ``key`` of the pages that were still to do.

    What the checkpoint calls done is left out, errors are tried again; what the
    cache (``key, text``) holds is ``skipped_cached``.  The rest start in order, in
    waves, until ``cap`` is really spent: a wave has as many pages as could start
    one after the other if each cost ``cost``, or ``in_flight`` if that is more, and the
    next begins when what it did cost is known.  Pages that fail or are blank
    cost nothing, so that others take their place.  Each wave is stored before
    the next, so that each page is read once; a page that is listed twice is one.

    After a wave that cost less than half of that, one task goes on page by page, for
    at most ``ALONE`` seconds: what it starts is what could start one after the other,
    so that stretches of pages that cost nothing need no wave for every few of them.
    Contents for waves to come are stored ``AHEAD`` pages at a time, more while they are
    read faster than that.

    If the cap is reached with pages left, ``BudgetExceeded`` tells so and has the progress.
    """
    keyed = pages.select("file", F.col("page").cast("int").alias("page"), F.sha2(F.col("content").cast("binary"), 256).alias("key")).dropDuplicates(["file", "page"])
    todo = materialise(keyed.join(done(checkpoint), ["file", "page"], "left_anti"), "todo")  # contents stay where they are
    held = cache.select("key", "text").dropDuplicates(["key"])
    skipped = todo.join(held, "key").select("file", "page", F.lit("skipped_cached").alias("status"), F.lit(None).cast("string").alias("error_msg"), "text", F.lit(0.0).alias("cost_usd"), "key", F.lit(None).cast("long").alias("seq"))
    waves = [materialise(skipped, "progress")]
    work = in_order(todo.join(held, "key", "left_anti"))
    n, at, spent = work.count(), 0, 0
    micro = lambda usd: round(usd * 1_000_000)
    block, end, ahead = None, 0, AHEAD

    def store(rows: DataFrame) -> int:
        waves.append(materialise(rows, "progress"))
        return waves[-1].agg(F.sum(F.round(F.col("cost_usd") * 1_000_000).cast("long"))).first()[0] or 0

    while at < n and spent < micro(cap):
        many = n - at if micro(cost) <= 0 else min(n - at, max(in_flight, -(-(micro(cap) - spent) // micro(cost))))
        if at + many > end:
            end = min(n, at + max(many, ahead))
            block = _with_contents(pages, work.where((F.col("seq") >= at) & (F.col("seq") < end)))
            block = block if end == at + many else materialise(block, "contents")
        took = store(run_pages(block.where((F.col("seq") >= at) & (F.col("seq") < at + many)), read, cost, ("key", "seq")))
        spent, at = spent + took, at + many
        if at < end and spent < micro(cap) and 2 * took < many * micro(cost):
            spent += store(run_until(block.where(F.col("seq") >= at), read, cost, micro(cap) - spent, ALONE, ("key", "seq")))
            at = max(at, (waves[-1].agg(F.max("seq")).first()[0] or 0) + 1)
            ahead = min(2 * ahead, MOST_AHEAD) if at == end else ahead
    progress = reduce(DataFrame.unionByName, waves).drop("seq")
    if at < n:
        raise BudgetExceeded(spent / 1_000_000, cap, progress)
    return progress


def _with_contents(pages: DataFrame, wave: DataFrame) -> DataFrame:
    """The rows of ``wave`` with ``content``; a page that is listed more than once has one of its contents."""
    ends = wave.agg(F.min("file"), F.max("file")).first()  # lets the scan of contents skip files
    contents = pages.where(F.col("file").between(*ends)).select("file", F.col("page").cast("int").alias("page"), "content")
    rows = contents.join(wave, ["file", "page"])
    return rows.dropDuplicates(["file", "page"]) if pages_repeat(contents, wave) else rows


def pages_repeat(contents: DataFrame, wave: DataFrame) -> bool:
    """Whether a page of a wave is listed more than once."""
    return contents.select("file", "page").join(wave.select("file", "page"), ["file", "page"], "left_semi").groupBy("file", "page").count().where("count > 1").limit(1).count() > 0


def check_errors(progress: DataFrame) -> None:
    """Raise if pages of a run failed; to be called once progress is written."""
    n = progress.where("status = 'error'").count()
    if n:
        first = progress.where("status = 'error'").orderBy("file", "page").first()
        raise RuntimeError(f"{n} pages failed, first {first['file']} p.{first['page']}: {first['error_msg']}")


def summary(progress: DataFrame) -> DataFrame:
    """One row: pages done, skipped, failed, their cost, and the seconds of the run if rows tell them (``elapsed_s`` so far)."""
    one = lambda s: F.count_if(F.col("status") == s)
    return progress.agg(one("done").alias("n_done"), one("skipped_cached").alias("n_skipped"), one("error").alias("n_error"), F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 6).alias("cost_usd"), *([F.round(F.max("elapsed_s"), 3).alias("elapsed_s")] if "elapsed_s" in progress.columns else []))


def progress_marks(progress: DataFrame, every: int, by: str = "lane") -> DataFrame:
    """Every so many pages of a lane: ``n`` so far and the time left by the mean pace (``seq, elapsed_s, total``)."""
    n = F.row_number().over(Window.partitionBy(by).orderBy("seq"))
    rows = progress.withColumn("n", n).where((F.col("n") % every == 0) | (F.col("n") == F.col("total")))
    return rows.select(by, "n", "total", F.round(F.col("elapsed_s") / F.col("n") * (F.col("total") - F.col("n")), 3).alias("eta_s"))


def cached(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a cache holds of what is wanted, and what is left to compute; each key once."""
    hits = wanted.join(cache, keys, "inner")
    misses = wanted.join(cache.select(*keys), keys, "left_anti").dropDuplicates(keys)
    return hits, misses
