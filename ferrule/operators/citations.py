"""Answers: prompts, citation checks, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.functions.text import citations, sentences, strip, words

#: What an answer says when the passages do not hold one.
NO_ANSWER = "The documents do not contain the information needed to answer this."
SYSTEM_RULES = "Cite every fact as [file p.N]. If the passages do not hold the answer, reply exactly: " + NO_ANSWER


def validated(text: Column, context: Column, fallback: str = NO_ANSWER) -> Column:
    """``text, citations, n_dropped`` of an answer against its context (an array of ``file, page``).

    A sentence stays if at least one of its citations is in the context; its
    other citations leave the list but not the text.  The fallback itself
    passes; an answer with nothing left becomes it.
    """
    key = lambda x: F.concat_ws("\x00", x["file"], x["page"].cast("string"))
    known = F.transform(context, key)
    judged = F.transform(sentences(text), lambda s: F.struct(s.alias("s"), F.filter(citations(s), lambda c: F.array_contains(known, key(c))).alias("ok")))
    kept = F.filter(judged, lambda j: F.size(j["ok"]) > 0)
    found = F.flatten(F.transform(kept, lambda j: j["ok"]))
    dropped = F.size(judged) - F.size(kept)
    none = F.array().cast("array<struct<file:string,page:int>>")
    as_is = strip(text) == fallback
    return F.struct(
        F.when(as_is, F.lit(fallback)).when(F.size(kept) > 0, F.array_join(F.transform(kept, lambda j: j["s"]), " ")).otherwise(F.lit(fallback)).alias("text"),
        F.when(as_is, none).otherwise(found).alias("citations"),
        F.when(as_is, F.lit(0)).otherwise(dropped).alias("n_dropped"),
    )


def validate_by_join(answers: DataFrame, context: DataFrame) -> DataFrame:
    """The same by joins, where contexts are a table: ``answer_id, text, n_dropped`` of ``answers`` (``answer_id, text``) and ``context`` (``answer_id, file, page``)."""
    split = answers.select("answer_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))
    cited = split.select("answer_id", "pos", F.explode(citations(F.col("sentence"))).alias("c")).select("answer_id", "pos", "c.file", "c.page")
    good = cited.join(context.select("answer_id", "file", "page"), ["answer_id", "file", "page"], "left_semi").select("answer_id", "pos").distinct()
    marked = split.join(good.withColumn("ok", F.lit(True)), ["answer_id", "pos"], "left")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("pos", "sentence")))), lambda x: x["sentence"]), " ")
    out = marked.groupBy("answer_id").agg(text.alias("text"), F.count_if(F.col("ok").isNull()).alias("n_dropped"))
    return out.withColumn("text", F.when(F.col("text") == "", F.lit(NO_ANSWER)).otherwise(F.col("text")))


def confidence(scores: Column) -> Column:
    """``high``, ``medium`` or ``low``, by the mean of the first five scores."""
    five = F.slice(scores, 1, 5)
    mean = F.aggregate(five, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(five), F.lit(0))
    return F.when(mean > 0.7, "high").when(mean > 0.5, "medium").otherwise("low")


def prompt_block(file: Column, page: Column, kind: Column, text: Column) -> Column:
    """A chunk as the model gets to see it; markup in it cannot close its frame."""
    safe = F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    name = F.replace(file, F.lit('"'), F.lit("&quot;"))
    return F.concat(F.lit('<context_chunk file="'), name, F.lit('" page="'), page.cast("string"), F.lit('" type="'), kind, F.lit('">\n'), safe, F.lit("\n</context_chunk>"))


def prompts(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """``query_id, context``: the passages of each question (``query_id``) in rank order, framed; a mark where there are none."""
    blocks = ranked.select("query_id", "rank", prompt_block(F.col("file"), F.col("page"), F.col("chunk_type"), F.col("text")).alias("block"))
    joined = blocks.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"]), "\n").alias("context"))
    return questions.select("query_id").join(joined, "query_id", "left").select("query_id", F.coalesce("context", F.lit('<context_chunk note="no chunks retrieved"/>')).alias("context"))


def context_lines(ranked: DataFrame, most: int = 6000) -> DataFrame:
    """``query_id, context``: passages as lines ``[file p.N] text`` up to ``most`` characters, the last one cut."""
    line = F.concat(F.lit("["), F.col("file"), F.lit(" p."), F.col("page").cast("string"), F.lit("] "), F.col("text"))
    before = F.coalesce(F.sum(F.length("line") + 1).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = ranked.select("query_id", "rank", line.alias("line")).withColumn("before", before).where(F.col("before") < most)
    cut = F.substr("line", F.lit(1), F.least(F.length("line"), F.lit(most) - F.col("before")).cast("int"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", cut.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def extractive_answer(questions: DataFrame, ranked: DataFrame, passages: int = 5) -> DataFrame:
    """A deterministic stand-in for a model: of each of the first passages the sentence that shares most words with the question, cited."""
    asked = questions.select("query_id", F.array_distinct(words(F.col("text"))).alias("_asked"))
    shared = F.transform(sentences(F.col("text")), lambda s, i: F.struct((-F.size(F.array_intersect(words(s), F.col("_asked")))).alias("n"), i.alias("i"), s.alias("s")))
    top = ranked.where(F.col("rank") <= passages).join(asked, "query_id").withColumn("s", F.array_min(shared)["s"]).where("s IS NOT NULL")
    cited = F.concat(F.regexp_replace("s", r"[。！？.!?]+$", ""), F.lit(" ["), F.col("file"), F.lit(" p."), F.col("page").cast("string"), F.lit("]."))
    text = top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", cited.alias("c")))), lambda x: x["c"]), " ").alias("text"))
    return questions.select("query_id").join(text, "query_id", "left").select("query_id", F.coalesce("text", F.lit(NO_ANSWER)).alias("text"))
