"""Ingest, search, ask and evaluate as whole plans."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.config import CONTRACT_STRUCTURE, Structure
from ferrule.functions.text import indexable, preview
from ferrule.operators import bm25, citations, evaluation, fusion, graph, vector
from ferrule.operators.chunking import chunk_pages
from ferrule.plans.slots import Slots, captioned
from ferrule.sources.page_files import read_page_files
from ferrule.sources.scratch import materialise

#: Fixed values.
RETRIEVED, ANSWERED_FROM, MOST_RESULTS, MOST_QUESTION = 10, 5, 50, 1000
#: What a vector carries of its chunk, as points of a vector store do.
PAYLOAD = ("file", "page", "chunk_type", "question_no")


@dataclass
class Collection:
    """A collection's tables.  ``chunks`` has ``chunk_id, ord, text, file, page, chunk_type`` and the reference fields."""

    chunks: DataFrame
    #: ``chunk_id, embedding``, and what ``PAYLOAD`` names
    vectors: DataFrame
    index: bm25.Index
    edges: DataFrame
    #: What captioning adds to its cache.
    new_captions: DataFrame | None = None


def ingest(pages: DataFrame, structure: Structure = CONTRACT_STRUCTURE, slots: Slots = Slots(), images: DataFrame | None = None, captions: DataFrame | None = None, model: str = "", profile: str | None = None) -> Collection:  # noqa: B008
    """Pages to chunks, vectors, keyword index and reference graph.

    With ``images`` (``file, page, image``) drawing chunks get a caption before they are
    indexed, through the cache ``captions`` (``key, payload``); images are turned by the
    ``rotation`` of their page.  ``new_captions`` of the collection are to be added to it.
    """
    chunks = chunk_pages(pages, structure)
    if images is None:
        return collect(chunks, slots)
    turns = pages.where("rotation <> 0").select("file", F.col("page_num").alias("page"), "rotation") if "rotation" in pages.columns else None
    chunks, new = captioned(materialise(chunks, "uncaptioned"), images, slots, turns, captions, model, profile)
    return replace(collect(chunks, slots), new_captions=new)


def ingest_path(spark: SparkSession, path: str, structure: Structure = CONTRACT_STRUCTURE, slots: Slots = Slots()) -> Collection:  # noqa: B008
    """Files to a collection: pages as ``slots.parse`` finds them, or as the library's own data source does."""
    parse = slots.parse or read_page_files
    return ingest(parse(spark, path), structure, slots)


def collect(chunks: DataFrame, slots: Slots = Slots()) -> Collection:  # noqa: B008
    """A collection of chunks; chunks that come again replace their content."""
    # dealt by id first, so that rows are sorted once, in parts of a shuffle, and not before it too; of equal places the last file's is taken
    rows = chunks.withColumn("chunk_id", F.col("id")).repartition("chunk_id")
    last = F.max_by(F.struct(*(c for c in rows.columns if c not in ("chunk_id", "ord"))), F.struct("ord", "file")).alias("_l")
    # the chunk table comes first: vectors, index and graph are derived from what is stored
    rows = materialise(rows.groupBy("chunk_id").agg(F.min(F.struct("file", "ord")).alias("ord"), last).select("chunk_id", "ord", "_l.*"), "chunks")
    text = indexable(F.col("text"), F.col("caption"))
    vectors = materialise(rows.select("chunk_id", slots.embed(text).alias("embedding"), *PAYLOAD), "vectors")
    return Collection(rows, vectors, bm25.build(rows.select("chunk_id", "ord", text.alias("text")), slots.tokenise), graph.mentions(rows))


def ingest_read(pages: DataFrame, progress: DataFrame, structure: Structure = CONTRACT_STRUCTURE, slots: Slots = Slots()) -> Collection:  # noqa: B008
    """The second phase of a batch: ``pages`` with the text that its first phase read or found cached, as a collection."""
    texts = progress.where("status IN ('done', 'skipped_cached')").select("file", F.col("page").alias("page_num"), F.col("text").alias("_read"))
    read = pages.join(texts, ["file", "page_num"]).withColumn("text", F.coalesce("_read", F.lit(""))).select(*pages.columns)
    return ingest(read, structure, slots)


def counters(chunks: DataFrame) -> DataFrame:
    """One row: chunks, drawing chunks and drawn pages, and pages of a collection."""
    page = F.struct("file", "page")
    return chunks.agg(
        F.count("*").alias("n_chunks"), F.count_if(F.col("chunk_type") == "drawing").alias("n_drawings"),
        F.countDistinct(F.when(F.col("chunk_type") == "drawing", page)).alias("n_drawn_pages"), F.countDistinct(page).alias("n_pages"),
    )


def degraded(n_chunks: int, n_vectors: int) -> bool:
    """Whether a collection has vectors but no chunks: its keyword search finds nothing, and hybrid search is by vectors alone."""
    return n_chunks == 0 and n_vectors > 0


def check_index(c: Collection) -> None:
    """Warn of a collection that has vectors but nothing to search by words."""
    if c.index.n == 0 and degraded(0, c.vectors.limit(1).count()):
        warnings.warn("the collection has vectors but no chunks: search goes by vectors alone until its chunks are restored or ingested again", stacklevel=3)


def check_request(question: str, k: int = RETRIEVED) -> None:
    if not 1 <= len(question) <= MOST_QUESTION:
        raise ValueError(f"a question has 1 to {MOST_QUESTION} characters")
    if not 1 <= k <= MOST_RESULTS:
        raise ValueError(f"k is from 1 to {MOST_RESULTS}")


def search(c: Collection, queries: DataFrame, k: int = RETRIEVED, rerank: bool = False, slots: Slots = Slots()) -> DataFrame:  # noqa: B008
    """``query_id, rank, score, chunk_id, file, page, chunk_type, text, preview`` for all queries (``query_id, text``) at once."""
    check_index(c)
    dense = vector.top_k(c.vectors, queries.select("query_id", slots.embed(F.col("text")).alias("embedding")), fusion.CANDIDATES)
    sparse = bm25.top_k(c.index, queries, fusion.CANDIDATES, slots.tokenise)
    ranked = fusion.fuse(dense, sparse)
    if rerank:
        ranked = fusion.rerank(ranked, queries, c.chunks, slots.rerank)
    hits = ranked.where(F.col("rank") <= k).join(c.chunks.select("chunk_id", "file", "page", "chunk_type", "text"), "chunk_id")
    return hits.select("query_id", "rank", "score", "chunk_id", "file", "page", "chunk_type", "text", preview(F.col("text")).alias("preview"))


def ask(c: Collection, questions: DataFrame, slots: Slots | None = None, hits: DataFrame | None = None) -> DataFrame:
    """``query_id, text, citations, confidence`` for each question; without an answerer the first passages themselves are cited.  ``hits`` are what was found, if it was."""
    s = slots or Slots()
    hits = materialise(search(c, questions, RETRIEVED, slots=s), "hits") if hits is None else hits
    top = hits.where(F.col("rank") <= ANSWERED_FROM)
    pairs = top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "file", "page"))), lambda x: F.struct(x["file"].alias("file"), x["page"].alias("page"))).alias("context"))
    if slots is None:
        return questions.select("query_id").join(pairs, "query_id", "left").select("query_id", F.lit(citations.NO_ANSWER).alias("text"), F.col("context").alias("citations"), F.lit("none").alias("confidence"))
    drafts = s.answer(questions, hits).join(pairs, "query_id", "left")
    checked = drafts.select("query_id", citations.validated(F.col("text"), F.coalesce("context", F.array().cast("array<struct<file:string,page:int>>"))).alias("a"))
    level = citations.confidence(F.array_repeat(F.lit(0.6), 5))
    return checked.select("query_id", "a.text", "a.citations", F.when(F.size("a.citations") > 0, level).otherwise("low").alias("confidence"))


def evaluate(c: Collection, cases: DataFrame, slots: Slots | None = None) -> tuple[DataFrame, DataFrame]:
    """Per-case metrics and their means; all cases are searched at once."""
    queries = cases.select(F.col("case_id").alias("query_id"), F.col("question").alias("text"))
    found = materialise(search(c, queries, RETRIEVED, slots=slots or Slots()), "hits")
    hits = found.withColumnRenamed("query_id", "case_id")
    rows = cases.select("case_id", "category", "question", "expected_sources", "expected_keywords")
    for k in (5, 10):
        rows = rows.join(evaluation.recall(cases, hits, k).withColumnRenamed("recall", f"recall_{k}"), "case_id")
    rows = rows.join(hits.groupBy("case_id").agg(F.count("*").alias("n_retrieved")), "case_id", "left").fillna(0, ["n_retrieved"])
    metrics = ["recall_5", "recall_10"]
    if slots is not None:
        answers = ask(c, queries, slots, found).withColumnRenamed("query_id", "case_id").withColumnRenamed("text", "answer")
        passages = hits.where(F.col("rank") <= ANSWERED_FROM).groupBy("case_id").agg(F.collect_list("text").alias("passages"))
        rows = rows.join(answers, "case_id", "left").join(passages, "case_id", "left")
        rows = rows.withColumns({
            "citation_accuracy": evaluation.citation_accuracy(F.col("citations"), F.col("expected_sources")),
            "keyword_rate": evaluation.keyword_rate(F.col("answer"), F.col("expected_keywords")),
            "faithfulness": slots.faithfulness(F.col("answer"), F.col("passages")),
            "answer_relevancy": slots.relevancy(F.col("question"), F.col("answer")),
        })
        metrics += ["citation_accuracy", "keyword_rate", "faithfulness", "answer_relevancy"]
    return rows, evaluation.means(rows, metrics)


def snapshot(c: Collection, n: int) -> DataFrame:
    """The first chunks of a collection, with the number of all."""
    first = c.chunks.orderBy("ord").limit(n)
    return first.join(F.broadcast(c.chunks.agg(F.count("*").alias("total"))), how="cross").withColumn("n", F.row_number().over(Window.orderBy("ord")))
