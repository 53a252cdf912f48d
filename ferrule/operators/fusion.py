"""Reciprocal rank fusion, hybrid search and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import words

#: The constant of rank fusion; candidates of each backend; candidates to rerank.
RRF_K, CANDIDATES, RERANKED = 60, 20, 30


def fuse(*rankings: DataFrame, k: int | None = None) -> DataFrame:
    """Rankings (``query_id, chunk_id, rank``) as one, with ``score`` and ``rank``; equal scores stand in order of first sight."""
    # a union that keeps its sides' partitioning zips them, and fails where adaptive execution has coalesced one of them
    rankings[0].sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    lists = [r.select("query_id", "chunk_id", "rank", F.lit(i).alias("_list")) for i, r in enumerate(rankings)]
    both = lists[0]
    for other in lists[1:]:
        both = both.unionByName(other)
    first = F.min(F.struct("_list", "rank")).alias("_first")
    fused = both.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))), 12).alias("score"), first)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "_first", "chunk_id"))
    out = fused.select("query_id", "chunk_id", "score", rank.alias("rank"))
    return out if k is None else out.where(F.col("rank") <= k)


def overlap_score(question: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: shared words over all words."""
    a, b = F.array_distinct(words(question)), F.array_distinct(words(text))
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(F.size(F.array_union(a, b)), F.lit(0)), F.lit(0.0))


def rerank(fused: DataFrame, queries: DataFrame, chunks: DataFrame, score: Callable[[Column, Column], Column] = overlap_score, top: int = RERANKED) -> DataFrame:
    """The first ``top`` of each query by a new score; equal ones keep their order, later ones go."""
    head = fused.where(F.col("rank") <= top).select("query_id", "chunk_id", F.col("rank").alias("_before"))
    joined = head.join(queries.select("query_id", F.col("text").alias("_question")), "query_id").join(chunks.select("chunk_id", F.col("text").alias("_text")), "chunk_id")
    scored = joined.select("query_id", "chunk_id", F.round(score(F.col("_question"), F.col("_text")), 9).alias("score"), "_before")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "_before"))
    return scored.select("query_id", "chunk_id", "score", rank.alias("rank"))
