"""Queries on text functions, projections and chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.config import DOCUMENT
from ferrule.functions import segmentation
from ferrule.functions import text as T
from ferrule.operators import chunking
from ferrule.plans.registry import query
from ferrule.plans.slots import caption_prompt
from ferrule.sources.tables import pages_of, spread, table


def clauses(spark, d: str) -> DataFrame:
    """Contract prose made of order lines: ``key, file, page, text``."""
    li, part = table(spark, d, "lineitem"), table(spark, d, "part")
    text = F.format_string(
        "Section %d General\nClause %d.%d Delivery\nSee Drawing No. T/PRJ/%s/%d%s and cl. %d.%d, or Dwg. A/B/%d; clause %d.%d applies.",
        F.pmod("l_partkey", F.lit(9)), "l_linenumber", F.pmod("l_suppkey", F.lit(7)), F.replace("p_brand", F.lit("#"), F.lit("")), "l_partkey", F.substring("l_returnflag", 1, 1),
        "l_linenumber", F.pmod("l_partkey", F.lit(5)), "l_suppkey", "l_linenumber", F.pmod("l_partkey", F.lit(5)),
    )
    joined = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), F.concat(F.lit("docs/Order "), F.pmod("l_orderkey", F.lit(50)), F.lit(".v1.pdf")).alias("file"), F.col("l_linenumber").alias("page"), text.alias("text"))


CLAUSES_SQL = """
clauses AS (SELECT l_orderkey || '-' || l_linenumber AS key, 'docs/Order ' || (l_orderkey % 50) || '.v1.pdf' AS file, l_linenumber AS page,
  'Section ' || (l_partkey % 9) || ' General' || chr(10) || 'Clause ' || l_linenumber || '.' || (l_suppkey % 7) || ' Delivery' || chr(10) || 'See Drawing No. T/PRJ/' || replace(p_brand, '#', '') || '/' || l_partkey || l_returnflag
  || ' and cl. ' || l_linenumber || '.' || (l_partkey % 5) || ', or Dwg. A/B/' || l_suppkey || '; clause ' || l_linenumber || '.' || (l_partkey % 5) || ' applies.' AS text
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


@query("str_references", f"""WITH {CLAUSES_SQL}
SELECT key, list_sort(list_distinct(regexp_extract_all(text, '(?i)(?:Drawing\\s*No\\.?\\s*|Dwg\\.?\\s*)([\\w/\\-]+/\\d+[A-Z]?)', 1))) AS drawing_refs,
  list_sort(list_distinct(regexp_extract_all(text, '(?i)(?:Clause|Cl\\.?)\\s+(\\d+(?:\\.\\d+)*)', 1))) AS clause_refs FROM clauses""")
def references(spark, d):
    c = F.col("text")
    return clauses(spark, d).select("key", T.references(c, T.DRAWING_REF).alias("drawing_refs"), T.references(c, T.CLAUSE_REF).alias("clause_refs"))


@query("str_section_path", f"""WITH {CLAUSES_SQL}, h AS (SELECT key, regexp_extract_all(text, '(?im)^\\s*(Section\\s+\\d+[A-Z]?)\\b', 1) AS s, regexp_extract_all(text, '(?im)^\\s*(Clause\\s+\\d+(?:\\.\\d+)*)\\b', 1) AS c FROM clauses)
SELECT key, s[len(s)] || ' > ' || c[len(c)] AS section_path, s[len(s)] AS section_top FROM h""")
def section_path(spark, d):
    path = clauses(spark, d).select("key", T.section_path(F.col("text")).alias("section_path"))
    return path.withColumn("section_top", T.section_top(F.col("section_path")))


@query("str_chunk_id", f"""WITH {CLAUSES_SQL}
SELECT key, replace(regexp_replace(string_split(file, '/')[-1], '\\.[^.]*$', ''), ' ', '_') AS stem, replace(regexp_replace(string_split(file, '/')[-1], '\\.[^.]*$', ''), ' ', '_') || ':' || page || ':' || 0 AS id FROM clauses""")
def chunk_id(spark, d):
    return clauses(spark, d).select("key", T.file_stem(F.col("file")).alias("stem"), T.chunk_id(F.col("file"), F.col("page"), F.lit(0)).alias("id"))


def replies(spark, d: str) -> DataFrame:
    """Model replies made of chat turns: ``key`` and one column for each form of reply."""
    c = table(spark, d, "conversations")
    safe = F.regexp_replace("text", r"[^A-Za-z ]", "")
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("key"),
        F.concat(F.lit("<think>let me see\n</think> "), safe, F.when(F.col("turn") % 3 == 0, F.lit(" <think>and then")).otherwise(F.lit(""))).alias("thought"),
        F.concat(F.lit("```json\n{\"score\": "), F.when(F.col("turn") % 4 == 0, F.lit('"none"')).otherwise((F.col("turn") / 4).cast("string")), F.lit("}\n```")).alias("judged"),
        F.when(F.col("turn") % 5 == 0, F.lit("no object")).otherwise(F.concat(F.lit('```json\n{"caption_zh": "'), F.substring(safe, 1, 20), F.lit('", "entities": ["a", "b"]}\n```'))).alias("captioned"),
        F.concat(F.lit('{"type": "start"}\n{"text": "'), F.substring(safe, 1, 10), F.lit('"}\n{"content": "'), F.substring(safe, 11, 10), F.lit('"}\nend')).alias("events"),
        safe.alias("safe"), "turn",
    )


@query("str_model_replies", """WITH c AS (SELECT conv_id || '-' || turn AS key, regexp_replace(text, '[^A-Za-z ]', '', 'g') AS safe, turn FROM conversations)
SELECT key, regexp_replace(safe, '^ +| +$', '', 'g') AS answer,
  CASE WHEN turn % 4 <> 0 THEN least(greatest(turn / 4.0, 0), 1)::DOUBLE END AS score,
  CASE WHEN turn % 5 = 0 THEN '' ELSE substr(safe, 1, 20) END AS caption, CASE WHEN turn % 5 = 0 THEN 0 ELSE 2 END AS n_entities,
  substr(safe, 11, 10) AS last_text FROM c""")
def model_replies(spark, d):
    r = replies(spark, d)
    return r.select(
        "key", T.without_thoughts(F.col("thought")).alias("answer"), T.judge_score(F.col("judged")).alias("score"), T.caption_of(F.col("captioned"))["caption"].alias("caption"),
        F.size(T.caption_of(F.col("captioned"))["entities"]).alias("n_entities"), T.last_event_text(F.col("events")).alias("last_text"),
    )


@query("str_sentences", """SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)),
  lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '') AS sentences FROM documents""")
def sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", T.sentences(F.col("text")).alias("sentences"))


@query("str_citations", """WITH a AS (SELECT doc_id, '[' || source || ' p.' || (doc_id % 90) || '] ' || coalesce(text, '') || ' [x y.pdf p.7] [bad] [no p.x]' AS t FROM documents)
SELECT doc_id, regexp_extract_all(t, '\\[([^\\[\\]]+?)\\s+p\\.(\\d+)\\]', 1) AS files, list_transform(regexp_extract_all(t, '\\[([^\\[\\]]+?)\\s+p\\.(\\d+)\\]', 2), lambda x: CAST(x AS INTEGER)) AS cited FROM a""")
def citations(spark, d):
    t = F.concat(F.lit("["), F.col("source"), F.lit(" p."), F.col("doc_id") % 90, F.lit("] "), F.coalesce("text", F.lit("")), F.lit(" [x y.pdf p.7] [bad] [no p.x]"))
    c = T.citations(t)
    return table(spark, d, "documents").select("doc_id", F.transform(c, lambda x: x["file"]).alias("files"), F.transform(c, lambda x: x["page"]).alias("cited"))


@query("str_slug", """SELECT p_partkey, CASE WHEN p_type = 'none' THEN '' ELSE '.' || regexp_replace(regexp_replace(p_type || '/' || p_brand || '!', '[^A-Za-z0-9.-]+', '-', 'g'), '^-+|-+$', '', 'g') END AS slug,
  NOT contains(p_name, '/') AND NOT contains(p_name, '..') AND p_name <> '' AS safe FROM part""")
def slug(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slug(F.concat("p_type", F.lit("/"), "p_brand", F.lit("!")), "none").alias("slug"), T.safe_name(F.col("p_name")).alias("safe"))


@query("str_char_ratios", """WITH s AS (SELECT doc_id, regexp_replace(text, '\\s', '', 'g') AS t FROM documents)
SELECT doc_id, round(length(regexp_replace(t, '[^\\p{L}\\p{N}]', '', 'g')) / nullif(length(t), 0), 9) AS alnum, round(length(regexp_replace(t, '[\\x20-\\x7e‐-‧　-〿㐀-䶿一-鿿＀-￯]', '', 'g')) / nullif(length(t), 0), 9) AS garbled FROM s""")
def char_ratios(spark, d):
    r = T.char_ratios(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.round(r["alnum"], 9).alias("alnum"), F.round(r["garbled"], 9).alias("garbled"))


@query("str_table_cells", """SELECT o_orderkey, ['Order', 'a|b ' || o_orderpriority] AS cells, 'a\\|b ' || o_orderpriority AS escaped FROM orders""")
def table_cells(spark, d):
    html = F.concat(F.lit("<table><tr><th> Order\n</th><td class='x'>a|b  <b>"), F.col("o_orderpriority"), F.lit("</b></td></tr></table>"))
    cells = T.cell_texts(html)
    return table(spark, d, "orders").select("o_orderkey", cells.alias("cells"), T.markdown_cell(cells[1]).alias("escaped"))


@query("str_keyword", "SELECT doc_id, contains(lower(text), lower('THE')) AS hit FROM documents")
def keyword(spark, d):
    return table(spark, d, "documents").select("doc_id", T.contains_folded(F.col("text"), F.lit("THE")).alias("hit"))


@query("prj_indexable", """SELECT doc_id, text || CASE WHEN lang = 'en' THEN chr(10) || chr(10) || 'Caption: ' || source ELSE '' END AS indexed FROM documents""")
def indexable(spark, d):
    caption = F.when(F.col("lang") == "en", F.col("source")).when(F.col("lang") == "de", F.lit(""))
    return table(spark, d, "documents").select("doc_id", T.indexable(F.col("text"), caption).alias("indexed"))


@query("prj_preview", """SELECT doc_id, substr(replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(10), ' '), 1, 200) AS preview,
  replace(substr(regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ +| +$', '', 'g'), 1, 80), '|', '\\|') AS gallery FROM documents""")
def preview(spark, d):
    return table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"), T.gallery_preview(F.col("text")).alias("gallery"))


@query("prj_page_kinds", """SELECT CASE WHEN doc_id % 7 = 0 THEN 'drawing' ELSE 'text' END AS page_kind, count(*) AS n FROM documents GROUP BY 1""")
def page_kinds(spark, d):
    pages = table(spark, d, "documents").withColumn("page_kind", F.when(F.col("doc_id") % 7 == 0, "drawing").otherwise("text"))
    n = lambda p: p.groupBy("page_kind").agg(F.count("*").alias("n"))
    return n(chunking.text_pages(pages)).unionByName(n(chunking.drawing_pages(pages)))


@query("prj_caption_prompt", """SELECT doc_id, 'Near: ' || substr(text, 1, 1500) || ' as {"caption_zh": ""}' AS prompt FROM documents""")
def caption_prompts(spark, d):
    return table(spark, d, "documents").select("doc_id", caption_prompt('Near: {nearby_text} as {{"caption_zh": ""}}', F.col("text")).alias("prompt"))


@query("chk_split_long", """WITH RECURSIVE r(doc_id, text, start, stop) AS (
  SELECT doc_id, text, 0, CASE WHEN length(text) <= 1000 THEN length(text) ELSE
    CASE WHEN length(regexp_extract(substr(text, 401, 400), '(?s)^(.*[.!?。！？])(?:\\s|$)', 1)) > 0 THEN 400 + length(regexp_extract(substr(text, 401, 400), '(?s)^(.*[.!?。！？])(?:\\s|$)', 1)) ELSE 800 END END
  FROM documents WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, text, stop, CASE WHEN length(text) - stop <= 800 THEN length(text) ELSE
    stop + CASE WHEN length(regexp_extract(substr(text, stop + 401, 400), '(?s)^(.*[.!?。！？])(?:\\s|$)', 1)) > 0 THEN 400 + length(regexp_extract(substr(text, stop + 401, 400), '(?s)^(.*[.!?。！？])(?:\\s|$)', 1)) ELSE 800 END END
  FROM r WHERE stop < length(text))
SELECT doc_id, start, substr(text, start + 1, stop - start) AS piece FROM r""")
def split_long(spark, d):
    rows = spread(table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")).select("doc_id", F.explode(chunking.split_long(F.col("text"))).alias("p"))
    return rows.select("doc_id", F.col("p.start").alias("start"), F.col("p.text").alias("piece"))


@query("chk_page_starts", """WITH p AS (SELECT source || '-' || (doc_id // 400) AS file, row_number() OVER (PARTITION BY source || '-' || (doc_id // 400) ORDER BY doc_id) AS page_num, text FROM documents)
SELECT file, page_num, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY file ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM p""")
def page_starts(spark, d):
    return chunking.page_starts(pages_of(table(spark, d, "documents"))).select("file", "page_num", F.col("start").cast("long").alias("start"))


@query("chk_page_of_offset", """WITH p AS (SELECT source || '-' || (doc_id // 400) AS file, row_number() OVER (PARTITION BY source || '-' || (doc_id // 400) ORDER BY doc_id) AS page_num, text FROM documents),
s AS (SELECT file, page_num, coalesce(sum(length(text) + 1) OVER (PARTITION BY file ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
o AS (SELECT DISTINCT source || '-' || (doc_id // 400) AS file, CAST(doc_id * 37 % 20000 AS BIGINT) AS "offset" FROM documents)
SELECT o.file, o."offset", CAST(max(page_num) AS INTEGER) AS page FROM o JOIN s ON o.file = s.file AND s.start <= o."offset" GROUP BY ALL""")
def page_of_offset(spark, d):
    docs = table(spark, d, "documents")
    pages = pages_of(docs)
    offsets = docs.select(F.concat_ws("-", "source", F.floor(F.col("doc_id") / 400).cast("string")).alias("file"), (F.col("doc_id") * 37 % 20000).alias("offset")).distinct()
    return chunking.page_of_offset(offsets, pages)


NEUTRAL = """WITH RECURSIVE p AS (SELECT source || '-' || (doc_id // 400) AS file, row_number() OVER (PARTITION BY source || '-' || (doc_id // 400) ORDER BY doc_id) AS page_num, coalesce(text, '') AS text FROM documents),
f AS (SELECT file, string_agg(text || chr(10), '' ORDER BY page_num) AS text FROM p GROUP BY file),
s AS (SELECT file, page_num, coalesce(sum(length(text) + 1) OVER (PARTITION BY file ORDER BY page_num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM p),
r(file, text, start, stop) AS (
  SELECT file, text, 0, CASE WHEN length(text) <= 1000 THEN length(text) ELSE
    CASE WHEN length(regexp_extract(substr(text, 401, 400), '(?s)^(.*[.!?。！？])(?:\\s|$)', 1)) > 0 THEN 400 + length(regexp_extract(substr(text, 401, 400), '(?s)^(.*[.!?。！？])(?:\\s|$)', 1)) ELSE 800 END END FROM f
  UNION ALL
  SELECT file, text, stop, CASE WHEN length(text) - stop <= 800 THEN length(text) ELSE
    stop + CASE WHEN length(regexp_extract(substr(text, stop + 401, 400), '(?s)^(.*[.!?。！？])(?:\\s|$)', 1)) > 0 THEN 400 + length(regexp_extract(substr(text, stop + 401, 400), '(?s)^(.*[.!?。！？])(?:\\s|$)', 1)) ELSE 800 END END
  FROM r WHERE stop < length(text)),
c AS (SELECT file, start, regexp_replace(substr(text, start + 1, stop - start), '^\\s+|\\s+$', '', 'g') AS piece FROM r),
g AS (SELECT c.file, c.start, any_value(piece) AS text, max(page_num) AS page FROM c JOIN s ON c.file = s.file AND s.start <= c.start WHERE piece <> '' GROUP BY c.file, c.start)
SELECT file || ':' || page || ':' || (row_number() OVER (PARTITION BY file ORDER BY start) - 1) AS id, file, CAST(page AS INTEGER) AS page, 'paragraph' AS chunk_type, text FROM g"""


@query("chk_neutral_pieces", NEUTRAL)
def neutral_pieces(spark, d):
    """The standard texts have no blank lines: a file is one paragraph, cut into pieces."""
    return chunking.chunk_pages(pages_of(table(spark, d, "documents")), DOCUMENT.structure).select("id", "file", "page", "chunk_type", "text")


_NEUTRAL_REFERENCES = """SELECT *, list_sort(list_distinct(regexp_extract_all(text, '(?i)(?:Drawing\\s*No\\.?\\s*|Dwg\\.?\\s*)([\\w/\\-]+/\\d+[A-Z]?)', 1))) AS drawing_refs,
  list_sort(list_distinct(regexp_extract_all(text, '(?i)(?:Clause|Cl\\.?)\\s+(\\d+(?:\\.\\d+)*)', 1))) AS clause_refs, CAST(regexp_extract(id, '[0-9]+$') AS BIGINT) AS ord"""


@query("chk_neutral", f"{_NEUTRAL_REFERENCES} FROM ({NEUTRAL})")
def neutral(spark, d):
    return chunking.chunk_pages(pages_of(table(spark, d, "documents")), DOCUMENT.structure).select("id", "file", "page", "chunk_type", "text", "drawing_refs", "clause_refs", "ord")


def contract_pages(spark, d: str) -> DataFrame:
    """Pages with questions, sections and clauses, and some drawings, made of orders."""
    o = table(spark, d, "orders")
    text = F.format_string(
        "Section %d\nClause %d.%d\nIntroduction to %s. It goes on for a while and says little.\n\nQuestion No. ACME/%s/%d\nWhat does Clause %d.%d require?\nAnswer: see Drawing No. T/P/%dA. Done.",
        F.pmod("o_orderkey", F.lit(9)), F.pmod("o_custkey", F.lit(9)), F.pmod("o_orderkey", F.lit(5)), "o_orderstatus", F.upper("o_orderstatus"), "o_custkey",
        F.pmod("o_custkey", F.lit(4)), F.pmod("o_orderkey", F.lit(3)), "o_custkey",
    )
    kind = F.when(F.col("o_orderkey") % 11 == 0, "drawing").otherwise("text")
    return o.select(F.concat(F.lit("c"), F.floor(F.col("o_orderkey") / 8), F.lit(".pdf")).alias("file"), F.pmod("o_orderkey", F.lit(8)).cast("int").alias("page_num"), text.alias("text"), kind.alias("page_kind"))


@query("chk_contract")
def contract(spark, d):
    return chunking.chunk_pages(contract_pages(spark, d)).select("id", "file", "page", "chunk_type", "section_path", "question_no", "text", "drawing_refs", "clause_refs", "ord")


@query("chk_drawings", """WITH o AS (SELECT 'c' || (o_orderkey // 8) || '.pdf' AS file, o_orderkey % 8 AS page_num, o_custkey, o_orderkey FROM orders WHERE o_orderkey % 11 = 0)
SELECT file, CAST(page_num AS INTEGER) AS page, ['T/P/' || o_custkey || 'A'] AS drawing_refs FROM o""")
def drawings(spark, d):
    return chunking.chunk_pages(contract_pages(spark, d)).where("chunk_type = 'drawing'").select("file", "page", "drawing_refs")


@query("chk_counts", """WITH o AS (SELECT 'c' || (o_orderkey // 8) || '.pdf' AS file, o_orderkey % 11 = 0 AS drawing FROM orders)
SELECT file, CAST(count(*) FILTER (NOT drawing) AS BIGINT) AS questions, CAST(count(*) FILTER (drawing) AS BIGINT) AS drawings FROM o GROUP BY file""")
def counts(spark, d):
    chunks = chunking.chunk_pages(contract_pages(spark, d))
    return chunks.groupBy("file").agg(F.count_if(F.col("chunk_type") == "qa_pair").alias("questions"), F.count_if(F.col("chunk_type") == "drawing").alias("drawings"))


@query("str_segments")
def segments(spark, d):
    """Benchmark texts without their blanks, cut again by the words of all documents and their counts."""
    letters = r"\p{L}"
    texts = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(rf"[{letters}]+"), F.lit(0))).alias("word"))
    lexicon = segmentation.lexicon(texts.groupBy("word").agg(F.count("*").alias("n")))
    glued = table(spark, d, "benchmark").select(F.replace("text", F.lit(" "), F.lit("")).alias("text"))
    return segmentation.cuts(glued, lexicon, letters).select("run", F.array_join("words", " ").alias("words"))
