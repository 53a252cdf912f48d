"""Retrieval and answer metrics, their means, and the comparison of two reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.text import contains_folded, words


def in_sources(file: Column, page: Column, sources: Column) -> Column:
    """Whether a page lies in one of the expected ranges; a missing bound is 0."""
    inside = lambda s: (s["file"] == file) & page.between(F.coalesce(s["page_min"], F.lit(0)), F.coalesce(s["page_max"], F.lit(0)))
    return F.coalesce(F.exists(sources, inside), F.lit(False))


def recall(cases: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """``case_id, recall``: 1 if any of the first ``k`` hits (``case_id, rank, file, page``) is expected, else 0."""
    near = hits.where(F.col("rank") <= k).join(cases.select("case_id", "expected_sources"), "case_id")
    found = near.where(in_sources(F.col("file"), F.col("page"), F.col("expected_sources"))).select("case_id").distinct().withColumn("hit", F.lit(1.0))
    return cases.select("case_id").join(found, "case_id", "left").select("case_id", F.coalesce("hit", F.lit(0.0)).alias("recall"))


def citation_accuracy(citations: Column, sources: Column) -> Column:
    """The share of citations that are expected; 0 without any."""
    good = F.size(F.filter(citations, lambda c: in_sources(c["file"], c["page"], sources)))
    return F.coalesce(good / F.nullif(F.size(citations), F.lit(0)), F.lit(0.0))


def keyword_rate(answer: Column, keywords: Column) -> Column:
    """The share of keywords that the answer holds, in any case; 0 without any."""
    hit = F.size(F.filter(keywords, lambda k: contains_folded(answer, k)))
    return F.coalesce(hit / F.nullif(F.size(keywords), F.lit(0)), F.lit(0.0))


def means(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """``category, n_cases`` and the mean of each metric, over all (category null, ``overall`` true) and by category, in one pass.

    Null metrics do not count; a case without a category is uncategorised.
    """
    named = rows.withColumn("category", F.coalesce("category", F.lit("_uncategorized")))
    out = named.rollup("category").agg(F.grouping("category").alias("g"), F.count("*").alias("n_cases"), *(F.round(F.avg(m), 6).alias(m) for m in metrics))
    return out.select((F.col("g") == 1).alias("overall"), "category", "n_cases", *metrics)


def as_long(means_: DataFrame, metrics: list[str]) -> DataFrame:
    """``category, metric, value``."""
    return means_.unpivot(["category"], metrics, "metric", "value")


def compare(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("category", "metric")) -> DataFrame:
    """Two long reports side by side with ``delta`` = b - a; what one lacks is null."""
    left = a.select(*(F.col(k).alias(f"_a_{k}") for k in keys), F.col("value").alias("a"))
    right = b.select(*(F.col(k).alias(f"_b_{k}") for k in keys), F.col("value").alias("b"))
    on = [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys]
    both = left.join(right, on, "full_outer")
    return both.select(*(F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys), "a", "b", F.round(F.col("b") - F.col("a"), 6).alias("delta"))


def question_share(question: Column, answer: Column) -> Column:
    """A deterministic stand-in for a judge of relevancy: the share of the question's words that the answer takes up; null without any."""
    asked = F.array_distinct(words(question))
    return F.size(F.array_intersect(asked, words(answer))) / F.nullif(F.size(asked), F.lit(0))


def supported_share(answer_sentences: Column, passages: Column) -> Column:
    """A deterministic stand-in for a judge: sentences that some passage holds; null without any."""
    held = F.size(F.filter(answer_sentences, lambda s: F.exists(passages, lambda p: contains_folded(p, s))))
    return held / F.nullif(F.size(answer_sentences), F.lit(0))
