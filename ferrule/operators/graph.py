"""The cross-reference graph: which chunk mentions which entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.text import section_top, strip

TYPES = ("drawing", "clause", "question_no", "revision", "section")


def mentions(chunks: DataFrame) -> DataFrame:
    """``chunk_id, type, value``: the distinct entities of each chunk."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    lists = {
        "drawing": F.coalesce("drawing_refs", F.array().cast("array<string>")), "clause": F.coalesce("clause_refs", F.array().cast("array<string>")),
        "question_no": one("question_no"), "revision": one("revision"), "section": F.array(section_top(F.col("section_path"))),
    }

    def tag(type_: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(type_).alias("type"), strip(v).alias("value")))

    tagged = [tag(t, values) for t, values in lists.items()]
    named = F.array_distinct(F.filter(F.concat(*tagged), lambda x: x["value"].isNotNull() & (x["value"] != "")))
    return chunks.select(F.col("id").alias("chunk_id"), F.explode(named).alias("e")).select("chunk_id", "e.type", "e.value")


def reindex(old_edges: DataFrame, new_chunks: DataFrame) -> DataFrame:
    """Edges after chunks are indexed again: edges once there stay, known ones are not doubled."""
    return old_edges.unionByName(mentions(new_chunks)).distinct()


def mentions_of(edges: DataFrame, chunks: DataFrame, type_: str, value: str) -> DataFrame:
    """The chunks that mention an entity, by file, page and id."""
    hit = edges.where((F.col("type") == type_) & (F.col("value") == value)).select("chunk_id")
    found = hit.join(chunks.select(F.col("id").alias("chunk_id"), "file", "page", "chunk_type"), "chunk_id")
    return found.select("chunk_id", "file", "page", "chunk_type").orderBy("file", "page", "chunk_id")


def entities_in(edges: DataFrame, chunk_id: str) -> DataFrame:
    return edges.where(F.col("chunk_id") == chunk_id).select("type", "value").orderBy("type", "value")


def stats(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: chunks, distinct entities, mentions, and distinct entities of each type."""
    by_entity = edges.groupBy("type", "value").agg(F.count("*").alias("n"))
    plural = {"drawing": "drawings", "clause": "clauses", "question_no": "question_nos", "section": "sections", "revision": "revisions"}
    counts = [F.count_if(F.col("type") == t).alias(name) for t, name in plural.items()]
    edge_row = by_entity.agg(F.count("*").alias("entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("mentions"), *counts)
    return chunks.agg(F.count_distinct("id").alias("chunks")).join(F.broadcast(edge_row), how="cross")
