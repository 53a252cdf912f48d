"""Dealing pages to providers by content, and the record of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checked_pool(pool: list[str]) -> list[str]:
    """The providers' names without blanks around them; there must be some, none empty, each once."""
    names = [p.strip() for p in pool]
    if not names or not all(names) or len(set(names)) < len(names):
        raise ValueError("the pool must hold providers, each once and none without a name")
    return names


def provider(digest: Column, pool: list[str]) -> Column:
    """The provider of a SHA-256 hex digest: the number it spells, modulo the pool's size; another digest is an error."""
    pool = checked_pool(pool)
    clean = F.lower(F.btrim(digest))
    digits = F.split(clean, "")
    left = F.aggregate(F.filter(digits, lambda d: d != ""), F.lit(0), lambda a, d: F.pmod(a * 16 + F.conv(d, 16, 10).cast("int"), F.lit(len(pool))))
    wrong = F.raise_error(F.concat(F.lit("not a SHA-256 digest in hex: "), F.coalesce(digest, F.lit("null"))))
    return F.when(clean.rlike("^[0-9a-f]{64}$"), F.element_at(F.array(*map(F.lit, pool)), left + 1)).otherwise(wrong.cast("string"))


def plan(pages: DataFrame, pool: list[str], task_kind: str = "ocr") -> DataFrame:
    """``file, page_num, content_hash, provider, task_kind`` of pages (``file, page_num, content``)."""
    digest = F.sha2(F.col("content").cast("binary"), 256)
    return pages.select("file", "page_num", digest.alias("content_hash")).select("file", "page_num", "content_hash", provider(F.col("content_hash"), pool).alias("provider"), F.lit(task_kind).alias("task_kind"))


def counts(plan_: DataFrame, pool: list[str]) -> DataFrame:
    """Pages of each provider of the pool, those without any included."""
    all_ = plan_.sparkSession.createDataFrame([(p,) for p in checked_pool(pool)], "provider string")
    return F.broadcast(all_).join(plan_.groupBy("provider").agg(F.count("*").alias("n")), "provider", "left").select("provider", F.coalesce("n", F.lit(0)).alias("n"))


KEY = ["content_hash", "task_kind", "provider"]


def new_records(recorded: DataFrame, offered: DataFrame) -> DataFrame:
    """The offered records whose key is not there yet; of several the earliest."""
    first = offered.groupBy(*KEY).agg(F.min_by(F.struct(*(c for c in offered.columns if c not in KEY)), "assigned_at").alias("_r")).select(*KEY, "_r.*")
    return first.join(recorded.select(*KEY), KEY, "left_anti").select(*offered.columns)
