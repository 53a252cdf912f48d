"""Queries on retrieval, the reference graph, answers and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.config import DOCUMENT
from ferrule.functions.text import sentences
from ferrule.operators import bm25, chunking, citations, evaluation, fusion, graph, vector
from ferrule.plans import search as plans
from ferrule.plans.fixtures import ORDER_LINES, order_lines
from ferrule.plans.queries_text import NEUTRAL
from ferrule.plans.registry import query
from ferrule.plans.slots import Slots
from ferrule.sources.tables import pages_of, spread, table


def doc_chunks(spark, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("ord"), "text"))


def questions(spark, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


TOKENS = """found AS MATERIALIZED (SELECT doc_id AS chunk_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS ts FROM documents),
tok AS MATERIALIZED (SELECT chunk_id, CASE WHEN len(ts) = 0 THEN ['__empty__'] ELSE ts END AS ts FROM found),
sized AS (SELECT chunk_id, len(ts) AS dl FROM tok), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sized),
post AS MATERIALIZED (SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, unnest(ts) AS term FROM tok) GROUP BY ALL),
raw AS MATERIALIZED (SELECT term, count(*) AS df, ln(max(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY term),
terms AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""
SCORED = TOKENS + """,
q AS (SELECT item_id AS query_id, term, count(*) AS qf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM q JOIN terms USING (term) JOIN post USING (term) JOIN sized USING (chunk_id), st GROUP BY ALL)"""


@query("spx_corpus_stats", f"WITH {TOKENS} SELECT n, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM terms) AS n_terms, (SELECT round(avg(raw), 6) FROM raw) AS mean_idf FROM st")
def corpus_stats(spark, d):
    i = bm25.build(doc_chunks(spark, d))
    raw = F.log(i.n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    return i.terms.agg(F.lit(i.n).cast("long").alias("n"), F.lit(round(i.avgdl, 6)).alias("avgdl"), F.count("*").alias("n_terms"), F.round(F.avg(raw), 6).alias("mean_idf"))


@query("spx_idf", f"WITH {TOKENS} SELECT term, df, round(idf, 6) AS idf FROM terms")
def idf(spark, d):
    return bm25.build(doc_chunks(spark, d)).terms.select("term", "df", F.round("idf", 6).alias("idf"))


RANKED = SCORED + """,
everything AS (SELECT query_id, chunk_id, coalesce(score, 0) AS score FROM (SELECT DISTINCT query_id FROM q) CROSS JOIN sized LEFT JOIN scored USING (query_id, chunk_id)),
sparse AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM everything QUALIFY rank <= 20)"""


@query("spx_bm25_top_k", f"WITH {RANKED} SELECT query_id, chunk_id, score, rank FROM sparse")
def bm25_top_k(spark, d):
    return bm25.top_k(bm25.build(doc_chunks(spark, d)), questions(spark, d))


@query("spx_latest", """WITH r AS (SELECT user_id AS chunk_id, event_id AS ord, event_type AS text FROM events)
SELECT chunk_id, min(ord) AS ord, arg_max(text, ord) AS text FROM r GROUP BY chunk_id""")
def latest(spark, d):
    return bm25.latest(table(spark, d, "events").select(F.col("user_id").alias("chunk_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("text")))


def vectors(spark, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def vector_queries(spark, d: str) -> DataFrame:
    return table(spark, d, "embeddings").where("vec_id % 25 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


COSINES = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
near AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))), 6) AS score,
  round(list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))), 9) AS s FROM v q, v c WHERE q.vec_id % 25 = 0),
dense AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS rank FROM near QUALIFY rank <= 20)"""


@query("vec_top_k", f"WITH {COSINES} SELECT query_id, chunk_id, score, rank FROM dense")
def vec_top_k(spark, d):
    return vector.top_k(vectors(spark, d), vector_queries(spark, d)).withColumn("score", F.round("score", 6))


@query("vec_upsert", """WITH o AS (SELECT vec_id AS id, vec_id AS ord, label FROM embeddings WHERE label < 5), n AS (SELECT vec_id AS id, vec_id + 1000000 AS ord, label + 100 AS label FROM embeddings WHERE vec_id % 3 = 0)
SELECT coalesce(n.id, o.id) AS id, coalesce(n.label, o.label) AS label FROM o FULL JOIN n ON o.id = n.id""")
def vec_upsert(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("ord"), "label")
    new = e.where("id % 3 = 0").select("id", (F.col("ord") + 1000000).alias("ord"), (F.col("label") + 100).alias("label"))
    return vector.upsert(e.where("label < 5"), new).select("id", "label")


@query("vec_count", "SELECT count(*) AS n, count(DISTINCT vec_id) AS n_points FROM embeddings")
def vec_count(spark, d):
    return vectors(spark, d).agg(F.count("*").alias("n"), F.count_distinct("chunk_id").alias("n_points"))


@query("vec_embed")
def vec_embed(spark, d):
    return vector.embed(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "embedding")


@query("fus_rrf", """WITH a AS (SELECT l_suppkey AS q, l_partkey AS c, row_number() OVER (PARTITION BY l_suppkey ORDER BY max(l_quantity) DESC, l_partkey) AS r FROM lineitem GROUP BY l_suppkey, l_partkey QUALIFY r <= 20),
b AS (SELECT l_suppkey AS q, l_partkey AS c, row_number() OVER (PARTITION BY l_suppkey ORDER BY max(l_extendedprice) DESC, l_partkey) AS r FROM lineitem GROUP BY l_suppkey, l_partkey QUALIFY r <= 20),
u AS (SELECT *, 0 AS l FROM a UNION ALL SELECT *, 1 FROM b), f AS (SELECT q, c, round(sum(1.0::DOUBLE / (60 + r)), 12) AS score, min(l * 1000 + r) AS first FROM u GROUP BY ALL)
SELECT q AS query_id, c AS chunk_id, round(score, 9) AS score, row_number() OVER (PARTITION BY q ORDER BY score DESC, first, c) AS rank FROM f QUALIFY rank <= 10""")
def rrf(spark, d):
    from pyspark.sql import Window

    li = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("query_id"), F.col("l_partkey").alias("chunk_id")).agg(F.max("l_quantity").alias("a"), F.max("l_extendedprice").alias("b"))
    rank = lambda c: li.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "chunk_id"))).where("rank <= 20")
    return fusion.fuse(rank("a"), rank("b"), k=10).withColumn("score", F.round("score", 9))


@query("fus_hybrid_search")
def hybrid(spark, d):
    """The flagship: keyword and vector search for all questions, fused."""
    chunks = doc_chunks(spark, d)
    slots = Slots()
    dense = vector.top_k(vector.embed(chunks), vector.embed(questions(spark, d)), fusion.CANDIDATES)
    sparse = bm25.top_k(bm25.build(chunks), questions(spark, d), fusion.CANDIDATES, slots.tokenise)
    return fusion.fuse(dense, sparse, k=10)


@query("fus_rerank", f"""WITH {RANKED}, w AS (SELECT doc_id AS chunk_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS ws FROM documents),
p AS (SELECT s.query_id, s.chunk_id, s.rank AS before, round(len(list_intersect(w.ws, b.ws)) / nullif(len(list_distinct(w.ws || b.ws)), 0), 9) AS score
  FROM sparse s JOIN w USING (chunk_id) JOIN (SELECT item_id AS query_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS ws FROM benchmark) b USING (query_id))
SELECT query_id, chunk_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before) AS rank FROM p""")
def rerank(spark, d):
    chunks, asked = doc_chunks(spark, d), questions(spark, d)
    return fusion.rerank(bm25.top_k(bm25.build(chunks), asked), asked, chunks)


def graph_chunks(spark, d: str) -> DataFrame:
    """Orders as chunks; their parts and suppliers as the drawings and clauses they mention."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.concat(F.lit(" D/"), F.col("l_partkey"))).alias("dr"), F.collect_list(F.concat(F.col("l_suppkey").cast("string"), F.lit(".1"))).alias("cr"))
    o = table(spark, d, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(
        F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("f"), F.col("o_custkey") % 20).alias("file"), (F.col("o_orderkey") % 300).cast("int").alias("page"),
        F.lit("paragraph").alias("chunk_type"), F.col("dr").alias("drawing_refs"), F.col("cr").alias("clause_refs"),
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("Q"), "o_custkey")).alias("question_no"), F.lit(None).cast("string").alias("revision"),
        F.concat(F.lit("Section "), F.col("o_orderkey") % 12, F.lit(" > Clause 1")).alias("section_path"),
    )


EDGES = """edges AS (SELECT DISTINCT 'o' || l_orderkey AS chunk_id, 'drawing' AS type, 'D/' || l_partkey AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION SELECT DISTINCT 'o' || l_orderkey, 'clause', l_suppkey || '.1' FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  UNION SELECT 'o' || o_orderkey, 'question_no', 'Q' || o_custkey FROM orders WHERE o_orderkey % 4 = 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem)
  UNION SELECT 'o' || o_orderkey, 'section', 'Section ' || (o_orderkey % 12) FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""


@query("grf_mentions", f"WITH {EDGES} SELECT * FROM edges")
def mentions(spark, d):
    return graph.mentions(graph_chunks(spark, d))


@query("grf_mentions_of", f"WITH {EDGES} SELECT chunk_id, 'f' || (o_custkey % 20) AS file, CAST(o_orderkey % 300 AS INTEGER) AS page, 'paragraph' AS chunk_type FROM edges JOIN orders ON chunk_id = 'o' || o_orderkey WHERE type = 'clause' AND value = '3.1'")
def mentions_of(spark, d):
    chunks = graph_chunks(spark, d)
    return graph.mentions_of(graph.mentions(chunks), chunks, "clause", "3.1")


@query("grf_entities_in", f"WITH {EDGES} SELECT type, value FROM edges WHERE chunk_id = 'o4'")
def entities_in(spark, d):
    return graph.entities_in(graph.mentions(graph_chunks(spark, d)), "o4")


@query("grf_stats", f"""WITH {EDGES}, e AS (SELECT DISTINCT type, value FROM edges)
SELECT (SELECT count(DISTINCT l_orderkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS chunks, count(*) AS entities, (SELECT count(*) FROM edges) AS mentions, count(*) FILTER (type = 'drawing') AS drawings,
  count(*) FILTER (type = 'clause') AS clauses, count(*) FILTER (type = 'question_no') AS question_nos, count(*) FILTER (type = 'section') AS sections, count(*) FILTER (type = 'revision') AS revisions FROM e""")
def graph_stats(spark, d):
    chunks = graph_chunks(spark, d)
    return graph.stats(graph.mentions(chunks), chunks)


@query("grf_reindex", f"WITH {EDGES} SELECT count(*) AS n FROM edges")
def reindex(spark, d):
    chunks = graph_chunks(spark, d)
    return graph.reindex(graph.mentions(chunks), chunks.where("page < 100")).agg(F.count("*").alias("n"))


def answers(spark, d: str) -> DataFrame:
    """Answers of three sentences with citations, true and false, and what was retrieved."""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", r"[^A-Za-z ]", "").alias("t"))
    word = F.substring("t", 1, 15)
    text = F.concat(
        F.lit("First "), word, F.lit(" [a.pdf p."), F.col("turn"), F.lit("]. Second has none. Third [b.pdf p.9][a.pdf p."), F.col("turn") + 1, F.lit("]. "),
        F.when(F.col("turn") % 4 == 0, F.lit("Fourth [ghost p.1].")).otherwise(F.lit("")),
    )
    context = F.when(F.col("turn") % 5 == 4, F.array().cast("array<struct<file:string,page:int>>")).otherwise(F.array(F.struct(F.lit("a.pdf").alias("file"), F.col("turn").cast("int").alias("page")), F.struct(F.lit("b.pdf").alias("file"), (F.col("turn") * 9).cast("int").alias("page"))))
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("answer_id"), "turn", word.alias("word"), text.alias("text"), context.alias("context"))


ANSWERS = """a AS (SELECT conv_id || '-' || turn AS answer_id, turn, 'First ' || substr(regexp_replace(text, '[^A-Za-z ]', '', 'g'), 1, 15) || ' [a.pdf p.' || turn || '].' AS s1, 'Third [b.pdf p.9][a.pdf p.' || (turn + 1) || '].' AS s3 FROM conversations),
v AS (SELECT *, turn % 5 <> 4 AS ok1, turn % 5 <> 4 AND turn = 1 AS ok3, 3 + CASE WHEN turn % 4 = 0 THEN 1 ELSE 0 END AS n FROM a)"""


@query("ans_validate", f"""WITH {ANSWERS} SELECT answer_id, CASE WHEN NOT ok1 THEN 'The documents do not contain the information needed to answer this.' WHEN ok3 THEN s1 || ' ' || s3 ELSE s1 END AS text,
  CAST(n - ok1::INT - ok3::INT AS INTEGER) AS n_dropped, CAST(ok1::INT + ok3::INT AS INTEGER) AS n_citations FROM v""")
def validate(spark, d):
    v = citations.validated(F.col("text"), F.col("context"))
    return answers(spark, d).select("answer_id", v.alias("v")).select("answer_id", "v.text", F.col("v.n_dropped").alias("n_dropped"), F.size("v.citations").alias("n_citations"))


@query("ans_validate_join", f"""WITH {ANSWERS} SELECT answer_id, CASE WHEN NOT ok1 THEN 'The documents do not contain the information needed to answer this.' WHEN ok3 THEN s1 || ' ' || s3 ELSE s1 END AS text, n - ok1::INT - ok3::INT AS n_dropped FROM v""")
def validate_join(spark, d):
    a = answers(spark, d)
    return citations.validate_by_join(a, a.select("answer_id", F.explode("context").alias("c")).select("answer_id", "c.file", "c.page"))


@query("ans_confidence", f"""WITH {ORDER_LINES}, s AS (SELECT l_orderkey, list((l_partkey % 100) / 128.0::DOUBLE ORDER BY n) AS s FROM li GROUP BY 1)
SELECT l_orderkey, CASE WHEN list_avg(s[1:5]) > 0.7 THEN 'high' WHEN list_avg(s[1:5]) > 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM s""")
def confidence(spark, d):
    score = F.struct("n", (F.pmod("l_partkey", F.lit(100)) / 128).alias("v"))
    s = order_lines(spark, d).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(score)), lambda x: x["v"]).alias("s"))
    return s.select("l_orderkey", citations.confidence(F.col("s")).alias("confidence"))


def passages(spark, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    return c.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), F.concat(F.lit('f"'), F.col("conv_id") % 5).alias("file"), F.col("turn").alias("page"), F.lit("paragraph").alias("chunk_type"), "text")


@query("prj_prompt", """WITH p AS (SELECT conv_id, turn, '<context_chunk file="f&quot;' || (conv_id % 5) || '" page="' || turn || '" type="paragraph">' || chr(10) || replace(replace(text, '<', '&lt;'), '>', '&gt;') || chr(10) || '</context_chunk>' AS b FROM conversations)
SELECT conv_id AS query_id, string_agg(b, chr(10) ORDER BY turn) AS context FROM p GROUP BY conv_id UNION ALL SELECT -1, '<context_chunk note="no chunks retrieved"/>'""")
def prompt(spark, d):
    p = passages(spark, d)
    return citations.prompts(p.select("query_id").distinct().unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("query_id"))), p)


@query("prj_context_lines", """WITH l AS (SELECT conv_id, turn, '[f"' || (conv_id % 5) || ' p.' || turn || '] ' || text AS line FROM conversations),
b AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
SELECT conv_id AS query_id, string_agg(substr(line, 1, CAST(400 - before AS BIGINT)), chr(10) ORDER BY turn) AS context FROM b WHERE before < 400 GROUP BY conv_id""")
def context_lines(spark, d):
    return citations.context_lines(passages(spark, d), 400)


def cases(spark, d: str) -> DataFrame:
    """Benchmark items as cases; the expected sources are ranges of pages."""
    b = table(spark, d, "benchmark")
    source = F.struct(F.concat(F.lit("src"), F.col("item_id") % 20).alias("file"), (F.col("item_id") % 7).cast("int").alias("page_min"), (F.col("item_id") % 7 + 40).cast("int").alias("page_max"))
    return b.select(
        F.col("item_id").alias("case_id"), F.col("text").alias("question"), F.when(F.col("item_id") % 9 == 0, F.array().cast("array<struct<file:string,page_min:int,page_max:int>>")).otherwise(F.array(source)).alias("expected_sources"),
        F.array(F.lit("the"), F.lit("que"), (F.col("item_id") % 10).cast("string")).alias("expected_keywords"), F.when(F.col("item_id") % 5 > 0, F.concat(F.lit("c"), F.col("item_id") % 5)).alias("category"),
    )


def case_hits(spark, d: str) -> DataFrame:
    """Ten hits for each case."""
    c = cases(spark, d).select("case_id", F.explode(F.sequence(F.lit(1), F.lit(10))).alias("rank"))
    return c.select("case_id", "rank", F.concat(F.lit("src"), (F.col("case_id") + F.col("rank") * 7) % 20).alias("file"), (F.col("rank") * 13 % 60).cast("int").alias("page"))


HITS = """h AS (SELECT item_id, r, (item_id + r * 7) % 20 = item_id % 20 AND (r * 13 % 60) BETWEEN item_id % 7 AND item_id % 7 + 40 AND item_id % 9 <> 0 AS hit FROM benchmark, range(1, 11) t(r)),
m AS (SELECT item_id, CAST(max((hit AND r <= 5)::INT) AS DOUBLE) AS recall_5, CAST(max(hit::INT) AS DOUBLE) AS recall_10, CASE WHEN item_id % 5 > 0 THEN 'c' || (item_id % 5) ELSE '_uncategorized' END AS category FROM h GROUP BY item_id)"""


@query("evl_recall", f"WITH {HITS} SELECT item_id AS case_id, recall_10 AS recall FROM m")
def recall(spark, d):
    return evaluation.recall(cases(spark, d), case_hits(spark, d), 10)


@query("evl_means", f"WITH {HITS} SELECT GROUPING(category) = 1 AS overall, category, count(*) AS n_cases, round(avg(recall_5), 6) AS recall_5, round(avg(recall_10), 6) AS recall_10 FROM m GROUP BY ROLLUP(category)")
def eval_means(spark, d):
    c, h = cases(spark, d), case_hits(spark, d)
    both = c.join(evaluation.recall(c, h, 5).withColumnRenamed("recall", "recall_5"), "case_id").join(evaluation.recall(c, h, 10).withColumnRenamed("recall", "recall_10"), "case_id")
    return evaluation.means(both, ["recall_5", "recall_10"])


@query("evl_citations", """WITH c AS (SELECT item_id, lower(text) AS q, item_id % 7 AS low, item_id * 13 % 60 AS a, item_id * 29 % 60 AS b FROM benchmark)
SELECT item_id AS case_id, CASE WHEN item_id % 9 = 0 THEN 0.0 ELSE ((a BETWEEN low AND low + 40)::INT + (b BETWEEN low AND low + 40)::INT) / 3.0::DOUBLE END AS accuracy,
  (contains(q, 'the')::INT + contains(q, 'que')::INT + contains(q, CAST(item_id % 10 AS VARCHAR))::INT) / 3.0::DOUBLE AS keywords FROM c""")
def citation_accuracy(spark, d):
    """Two citations of the expected file at pages in and out of its range, and one of another."""
    page = lambda n: (F.col("case_id") * n % 60).cast("int")
    file = F.concat(F.lit("src"), F.col("case_id") % 20)
    cited = F.array(*(F.struct(f.alias("file"), page(n).alias("page")) for f, n in ((file, 13), (file, 29), (F.lit("other"), 1))))
    return cases(spark, d).select("case_id", evaluation.citation_accuracy(cited, F.col("expected_sources")).alias("accuracy"), evaluation.keyword_rate(F.upper("question"), F.col("expected_keywords")).alias("keywords"))


@query("evl_compare", """WITH a AS (SELECT o_orderpriority AS category, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority < '4' GROUP BY 1), b AS (SELECT o_orderpriority AS category, avg(o_totalprice) AS v FROM orders WHERE o_orderpriority > '2' GROUP BY 1)
SELECT coalesce(a.category, b.category) AS category, 'price' AS metric, round(a.v, 4) AS a, round(b.v, 4) AS b, round(round(b.v, 4) - round(a.v, 4), 6) AS delta FROM a FULL JOIN b ON a.category = b.category""")
def compare(spark, d):
    o = table(spark, d, "orders").withColumn("category", F.col("o_orderpriority"))
    mean = lambda df: evaluation.as_long(df.groupBy("category").agg(F.round(F.avg("o_totalprice"), 4).alias("price")), ["price"])
    return evaluation.compare(mean(o.where("o_orderstatus <> 'F' AND category < '4'")), mean(o.where("category > '2'")))


@query("evl_judge", """WITH s AS (SELECT conv_id, turn, left(text, length(text) // 2) AS half, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)),
  lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS said FROM conversations WHERE regexp_matches(text, '\\S'))
SELECT conv_id || '-' || turn AS key, len(list_filter(said, lambda x: contains(lower(half), lower(x)))) / len(said)::DOUBLE AS score FROM s""")
def judge(spark, d):
    """The share of a turn's sentences that its first half holds."""
    c = table(spark, d, "conversations").where(F.col("text").rlike(r"\S"))
    half = F.left("text", F.floor(F.length("text") / 2).cast("int"))
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("key"), evaluation.supported_share(sentences(F.col("text")), F.array(half)).alias("score"))


def collection(spark, d: str) -> plans.Collection:
    from ferrule.plans.queries_text import contract_pages

    return plans.ingest(contract_pages(spark, d))


@query("plan_ingest")
def ingest(spark, d):
    return collection(spark, d).vectors.select("chunk_id", *plans.PAYLOAD, "embedding")


@query("plan_search")
def search(spark, d):
    asked = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("What does Question ACME "), F.col("p_partkey"), F.lit(" require?")).alias("text"))
    return plans.search(collection(spark, d), asked).select("query_id", "rank", "score", "chunk_id", "preview")


@query("plan_ask")
def ask(spark, d):
    asked = table(spark, d, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("What does Question ACME "), F.col("p_partkey"), F.lit(" require?")).alias("text"))
    return plans.ask(collection(spark, d), asked, Slots())


@query("plan_show", f"SELECT id AS chunk_id, page, count(*) OVER () AS total, CAST(row_number() OVER (ORDER BY file, CAST(regexp_extract(id, '[0-9]+$') AS BIGINT)) AS INTEGER) AS n FROM ({NEUTRAL}) QUALIFY n <= 20")
def show(spark, d):
    chunks = chunking.chunk_pages(pages_of(table(spark, d, "documents")), DOCUMENT.structure).select(F.col("id").alias("chunk_id"), "page", F.struct("file", "ord").alias("ord"))
    return plans.snapshot(plans.Collection(chunks, None, None, None), 20).select("chunk_id", "page", "total", "n")


@query("evl_run")
def run_cases(spark, d):
    """Per-case metrics of questions that ask for a page's own question, over the collection of these pages."""
    o = table(spark, d, "orders").where("o_orderkey % 100 = 0")
    page = F.pmod("o_orderkey", F.lit(8)).cast("int")
    source = F.struct(F.concat(F.lit("c"), F.floor(F.col("o_orderkey") / 8), F.lit(".pdf")).alias("file"), page.alias("page_min"), page.alias("page_max"))
    asked = o.select(
        F.col("o_orderkey").alias("case_id"), F.concat(F.lit("Question No. ACME/"), F.upper("o_orderstatus"), F.lit("/"), F.col("o_custkey")).alias("question"), F.array(source).alias("expected_sources"),
        F.array(F.concat(F.lit("T/P/"), F.col("o_custkey"))).alias("expected_keywords"), F.col("o_orderstatus").alias("category"),
    )
    rows, _ = plans.evaluate(collection(spark, d), asked, Slots())
    return rows.select("case_id", "category", "recall_5", "recall_10", "n_retrieved", "citation_accuracy", "keyword_rate", "faithfulness", "answer_relevancy")


@query("fus_hybrid_vectors", f"""WITH {RANKED}, {COSINES.replace("WHERE q.vec_id % 25 = 0", "JOIN documents ON c.vec_id = doc_id WHERE q.vec_id IN (SELECT item_id FROM benchmark)")},
u AS (SELECT query_id, chunk_id, rank, 0 AS l FROM dense UNION ALL SELECT query_id, chunk_id, rank, 1 FROM sparse), f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, min(l * 1000 + rank) AS first FROM u GROUP BY ALL)
SELECT query_id, chunk_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, chunk_id) AS rank FROM f QUALIFY rank <= 10""")
def hybrid_vectors(spark, d):
    """Hybrid search with stored vectors: those of a document's id, and of a question's."""
    chunks, asked = doc_chunks(spark, d), questions(spark, d)
    stored = vectors(spark, d)
    near = vector.top_k(stored.join(chunks.select("chunk_id"), "chunk_id", "left_semi"), stored.withColumnRenamed("chunk_id", "query_id").join(asked.select("query_id"), "query_id", "left_semi"))
    return fusion.fuse(near, bm25.top_k(bm25.build(chunks), asked), k=10).withColumn("score", F.round("score", 9))
