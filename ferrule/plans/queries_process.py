"""Queries on redaction, dispatch, batches and caches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.operators import batch, dispatch, redaction
from ferrule.plans.registry import query
from ferrule.plans.scanning import Reader, read_pages
from ferrule.plans.slots import Slots, cached_captions
from ferrule.sources import tables as sources
from ferrule.sources.scratch import materialise
from ferrule.sources.tables import table

POOL = ["alpha", "beta", "gamma"]


@query("dsp_assign", """SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, ['alpha', 'beta', 'gamma'][list_reduce(list_prepend(0, list_transform(string_split(sha256(coalesce(text, '')), ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS INTEGER))), lambda a, x: (a * 16 + x) % 3) + 1] AS provider FROM documents""")
def assign(spark, d):
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return table(spark, d, "documents").select("doc_id", digest.alias("content_hash"), dispatch.provider(digest, POOL).alias("provider"))


def plan(spark, d: str) -> DataFrame:
    return dispatch.plan(table(spark, d, "documents").select(F.col("source").alias("file"), F.col("doc_id").alias("page_num"), F.coalesce("text", F.lit("")).alias("content")), POOL)


@query("dsp_counts", """WITH p AS (SELECT ['alpha', 'beta', 'gamma'][list_reduce(list_prepend(0, list_transform(string_split(sha256(coalesce(text, '')), ''), lambda c: CAST(strpos('0123456789abcdef', c) - 1 AS INTEGER))), lambda a, x: (a * 16 + x) % 3) + 1] AS provider FROM documents)
SELECT u.provider, count(p.provider) AS n FROM (SELECT unnest(['alpha', 'beta', 'gamma']) AS provider) u LEFT JOIN p USING (provider) GROUP BY ALL""")
def counts(spark, d):
    return dispatch.counts(plan(spark, d), POOL)


@query("dsp_provenance", """SELECT DISTINCT sha256(coalesce(text, '')) AS content_hash, 'ocr' AS task_kind FROM documents WHERE sha256(coalesce(text, '')) NOT IN (SELECT sha256(coalesce(text, '')) FROM documents WHERE doc_id % 2 = 0)""")
def provenance(spark, d):
    records = plan(spark, d).select("content_hash", "provider", F.lpad(F.col("page_num").cast("string"), 12, "0").alias("assigned_at"), "task_kind", F.lit(None).cast("boolean").alias("redaction_applied"), F.lit("").alias("notes"), "page_num")
    known = records.where("page_num % 2 = 0").drop("page_num")
    return dispatch.new_records(known, records.drop("page_num")).select("content_hash", "task_kind")


def checkpoint(spark, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("f"), F.col("user_id") % 50).alias("file"), (F.col("event_id") % 40 + 1).cast("int").alias("page"), F.when(F.col("event_type") == "purchase", "error").when(F.col("event_id") % 3 == 0, "skipped_cached").otherwise("done").alias("status"), F.lit(None).cast("string").alias("error_msg"), F.round("value", 4).alias("cost_usd"))


CHECKPOINT = "c AS (SELECT 'f' || (user_id % 50) AS file, CAST(event_id % 40 + 1 AS INTEGER) AS page, CASE WHEN event_type = 'purchase' THEN 'error' WHEN event_id % 3 = 0 THEN 'skipped_cached' ELSE 'done' END AS status, round(value, 4) AS cost_usd FROM events)"


@query("bat_work_list", f"""WITH {CHECKPOINT}, a AS (SELECT 'f' || f AS file, CAST(p AS INTEGER) AS page FROM range(0, 60) x(f), range(1, 61) y(p)) SELECT file, page FROM a EXCEPT SELECT file, page FROM c WHERE status <> 'error'""")
def work_list(spark, d):
    files = spark.range(60).select(F.concat(F.lit("f"), "id").alias("file"), F.lit(60).alias("n_pages"))
    return batch.work_list(files, checkpoint(spark, d))


@query("bat_summary", f"WITH {CHECKPOINT} SELECT count(*) FILTER (status = 'done') AS n_done, count(*) FILTER (status = 'skipped_cached') AS n_skipped, count(*) FILTER (status = 'error') AS n_error, round(coalesce(sum(cost_usd), 0), 4) AS cost_usd FROM c")
def summary(spark, d):
    return batch.summary(checkpoint(spark, d)).withColumn("cost_usd", F.round("cost_usd", 4))


@query("bat_budget", """WITH w AS (SELECT user_id AS lane, event_id AS seq, CAST(round(value * 1000000) AS BIGINT) AS c FROM events), s AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY lane ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT lane, seq FROM s WHERE before / 1000000.0::DOUBLE < 100""")
def budget(spark, d):
    work = table(spark, d, "events").select(F.col("user_id").alias("lane"), F.col("event_id").alias("seq"), F.col("value").alias("cost_usd"))
    return batch.within_budget(work, 100.0).select("lane", "seq")


@query("bat_run_budget", """WITH w AS (SELECT o_orderpriority AS file, o_orderkey AS page, CAST(round(o_totalprice * 10) AS BIGINT) AS c FROM orders), s AS (SELECT *, coalesce(sum(c) OVER (ORDER BY file, page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM w)
SELECT file, page, before / 1000000.0::DOUBLE AS spent_before FROM s WHERE before < 1000000000""")
def run_budget(spark, d):
    """One cap for the whole run, in the order of files and pages."""
    work = table(spark, d, "orders").select(F.col("o_orderpriority").alias("file"), F.col("o_orderkey").alias("page"), (F.round(F.col("o_totalprice").cast("double") * 10) / 1_000_000).alias("cost_usd"))
    return batch.within_run_budget(work, 1000.0).select("file", "page", "spent_before")


@query("bat_run", """WITH p AS (SELECT source AS file, CAST(doc_id AS INTEGER) AS page, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS key FROM documents),
cached AS (SELECT DISTINCT key FROM p WHERE page % 3 = 0), todo AS (SELECT * FROM p WHERE page % 5 <> 0)
SELECT file, page, CASE WHEN key IN (SELECT key FROM cached) THEN 'skipped_cached' WHEN contains(t, 'q') THEN 'error' ELSE 'done' END AS status,
  CASE WHEN key NOT IN (SELECT key FROM cached) AND contains(t, 'q') THEN 'ValueError: unreadable' END AS error_msg,
  CASE WHEN key IN (SELECT key FROM cached) THEN 'cached' WHEN NOT contains(t, 'q') THEN t END AS text,
  CASE WHEN key IN (SELECT key FROM cached) OR contains(t, 'q') OR trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 0.0::DOUBLE ELSE 0.002::DOUBLE END AS cost_usd FROM todo""")
def run(spark, d):
    """A resumed run: some pages are done, some contents are cached, some pages fail."""

    def read(content: bytes) -> str:
        text = content.decode()
        if "q" in text:
            raise ValueError("unreadable")
        return text

    pages = table(spark, d, "documents").select(F.col("source").alias("file"), F.col("doc_id").cast("int").alias("page"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    seen = pages.where("page % 5 = 0").select("file", "page", F.lit("done").alias("status"))
    cached = pages.where("page % 3 = 0").select(F.sha2("content", 256).alias("key"), F.lit("cached").alias("text")).distinct()
    return batch.run_batch(pages, seen, cached, read, 0.002, 1e9).select("file", "page", "status", "error_msg", "text", "cost_usd")


@query("bat_spending", """WITH p AS (SELECT source AS file, CAST(doc_id AS INTEGER) AS page, coalesce(text, '') AS t FROM documents), c AS (SELECT *, CASE WHEN page % 10 < 3 OR trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' THEN 0 ELSE 2000 END AS micro FROM p),
s AS (SELECT *, coalesce(sum(micro) OVER (ORDER BY file, page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
SELECT file, page, CASE WHEN page % 10 < 3 THEN 'error' ELSE 'done' END AS status, micro / 1000000.0::DOUBLE AS cost_usd FROM s WHERE before < 200000""")
def spending(spark, d):
    """A run whose cap binds: three pages in ten fail, and others take their place until the cap is really spent."""
    pages = table(spark, d, "documents").select(F.col("source").alias("file"), F.col("doc_id").cast("int").alias("page"), F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary").alias("content"))

    def read(content: bytes) -> str:
        number, _, text = content.decode().partition(":")
        if int(number) % 10 < 3:
            raise ValueError("unreadable")
        return text

    seen, cached = pages.select("file", "page", F.lit("done").alias("status")).limit(0), spark.createDataFrame([], "key string, text string")
    try:
        progress = batch.run_batch(pages, seen, cached, read, 0.002, 0.2)
    except batch.BudgetExceeded as over:
        progress = over.progress
    return progress.select("file", "page", "status", "cost_usd")


def paper() -> Slots:
    """Page images as strings ``number:turn:dpi``, and an engine that reads them as such pages might read.

    Some lie on their side, some are hard to read, some seem empty at the plain resolution.
    """
    part = lambda image, i: F.split(image.cast("string"), ":")[i].cast("int")

    def ocr(image):
        n, turn, dpi = (part(image, i) for i in range(3))
        lies = F.when(n % 5 == 0, n % 4 * 90).otherwise(0)
        reading = lambda text, *scores: F.struct(F.lit(text).alias("text"), F.array(*scores).cast("array<double>").alias("scores"))
        poor = F.when(n % 7 == 0, 0.6).otherwise(0.95)
        return F.when((n % 11 == 0) & (dpi < 300), reading("")).when(n % 11 == 0, reading("z" * 10, F.lit(0.9))).when(turn != lies, reading("c" * 5, F.lit(0.4))).when(dpi < 300, reading("a" * 20, F.lit(0.9), poor)).otherwise(reading("b" * 30, F.lit(0.9)))

    return Slots(
        ocr=ocr, render=lambda file, page, dpi: F.concat_ws(":", page % 5000, F.lit(0), F.lit(dpi)).cast("binary"),
        turn=lambda image, degrees: F.concat_ws(":", part(image, 0), (part(image, 1) + degrees) % 360, part(image, 2)).cast("binary"),
    )


@query("scn_read_pages", """WITH p AS (SELECT o_orderkey AS page, o_orderkey % 5000 AS n FROM orders), q AS (SELECT *, n % 3 = 0 AS held, n % 11 = 0 AS blank, CASE WHEN n % 5 = 0 THEN n % 4 * 90 ELSE 0 END AS lies FROM p),
g AS (SELECT *, blank OR lies <> 0 OR n % 7 = 0 AS gated, blank OR n % 7 = 0 AS poor FROM q)
SELECT page, CASE WHEN held THEN 'cache' WHEN gated THEN 'probed' ELSE 'plain' END AS source, CAST(CASE WHEN held OR blank OR NOT gated THEN 0 ELSE lies END AS INTEGER) AS rotation, NOT held AND poor AS refined,
  CASE WHEN held THEN 'cached' WHEN blank THEN repeat('z', 10) WHEN poor THEN repeat('b', 30) ELSE repeat('a', 20) END AS text FROM g""")
def scan_pages(spark, d):
    """Pages through the gates: which come from the cache, which are turned, and which are rendered anew."""
    pages, reader, slots = table(spark, d, "orders").select(F.lit("f").alias("file"), F.col("o_orderkey").alias("page")), Reader("local", "m", "contract"), paper()
    image = slots.render(F.lit(""), F.col("n"), 150)
    keys = pages.select((F.col("page") % 5000).alias("n")).where("n % 3 = 0").distinct().select(F.concat(F.sha2(image, 256), F.lit(reader.suffix())).alias("key"))
    cache = keys.select("key", F.lit("cached").alias("text"), F.array(F.lit(0.1)).alias("scores"), F.lit(0).alias("rotation"), F.lit(False).alias("refined"))
    out, _ = read_pages(pages, reader, slots, cache)
    return out.select("page", "source", "rotation", "refined", "text")


@query("src_captions", """SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'old' WHEN doc_id % 4 = 1 THEN '' WHEN doc_id % 3 <> 0 THEN 'new' END AS caption FROM documents""")
def captions(spark, d):
    """Captions through a cache that holds some, empty ones too, and some payloads that are no text; a captioner that fails on some pages."""
    wanted = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("key"), F.lit(None).cast("binary").alias("image"), F.when(F.col("doc_id") % 3 != 0, "x").alias("nearby"))
    payload = F.when(F.col("doc_id") % 4 == 0, F.lit("old").cast("binary")).when(F.col("doc_id") % 4 == 1, F.lit("").cast("binary")).otherwise(F.unhex(F.lit("FFFE")))
    cache = wanted.where("doc_id % 4 < 3").select("key", payload.alias("payload"))
    out, _ = cached_captions(wanted, cache, Slots(caption=lambda image, nearby: F.when(nearby.isNotNull(), F.lit("new"))))
    return out.select("doc_id", "caption")


@query("bat_progress", """WITH e AS (SELECT user_id AS lane, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, count(*) OVER (PARTITION BY user_id) AS total FROM events)
SELECT lane, n, total, round((n * 2.0::DOUBLE) / n * (total - n), 3) AS eta_s FROM e WHERE n % 5 = 0 OR n = total""")
def progress(spark, d):
    from pyspark.sql import Window

    e = table(spark, d, "events").select(F.col("user_id").alias("lane"), F.col("event_id").alias("seq"))
    e = e.withColumn("total", F.count("*").over(Window.partitionBy("lane"))).withColumn("elapsed_s", F.row_number().over(Window.partitionBy("lane").orderBy("seq")) * 2.0)
    return batch.progress_marks(e, 5)


@query("src_cache", """WITH w AS (SELECT sha256(coalesce(text, '')) || '.text.txt' AS k FROM documents), c AS (SELECT DISTINCT sha256(coalesce(text, '')) || '.text.txt' AS k FROM documents WHERE doc_id % 2 = 0)
SELECT (SELECT count(*) FROM w WHERE k IN (SELECT k FROM c)) AS hits, (SELECT count(DISTINCT k) FROM w WHERE k NOT IN (SELECT k FROM c)) AS misses""")
def cache(spark, d):
    keyed = table(spark, d, "documents").select(sources.cache_key(F.coalesce("text", F.lit("")), "text").alias("k"), "doc_id")
    hits, misses = batch.cached(keyed.select("k"), keyed.where("doc_id % 2 = 0").select("k").distinct().withColumn("reading", F.lit("")), ["k"])
    return hits.agg(F.count("*").alias("hits")).join(misses.agg(F.count("*").alias("misses")), how="cross")


@query("src_merge_cache", "SELECT count(DISTINCT coalesce(text, '')) AS n FROM documents")
def merge_cache(spark, d):
    keyed = table(spark, d, "documents").select(sources.cache_key(F.coalesce("text", F.lit(""))).alias("k"), "doc_id")
    old = keyed.where("doc_id % 3 = 0").groupBy("k").agg(F.min("doc_id").alias("doc_id"))
    return sources.merge_cache(old, keyed, ["k"]).agg(F.count("*").alias("n"))


@query("src_caption_key", "SELECT doc_id, sha256(coalesce(text, '') || 'modelcaption[contract]') AS key FROM documents")
def caption_key(spark, d):
    return table(spark, d, "documents").select("doc_id", sources.caption_key(F.coalesce("text", F.lit("")), "model", "contract").alias("key"))


DICTIONARY = redaction.Dictionary({"ORG": ("The", "Then")}, {"MAIL": (r"[\w.]+@[\w.]+\w",)})


def spans(spark, d: str, strict: bool = False) -> DataFrame:
    return redaction.entities(table(spark, d, "documents"), DICTIONARY, strict)


@query("red_counts", """SELECT doc_id, CAST(len(regexp_extract_all(text, 'Then|The|[\\w.]+@[\\w.]+\\w')) AS INTEGER) AS n FROM documents WHERE len(regexp_extract_all(text, 'Then|The|[\\w.]+@[\\w.]+\\w')) > 0""")
def red_counts(spark, d):
    return spans(spark, d).groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))


@query("red_offsets", """WITH c AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS start, substr(text, i, 3) = 'The' AS whole, substr(text, i, 1) AS letter FROM documents, UNNEST(range(1, length(text) + 1)) u(i)),
s AS (SELECT doc_id, start, CASE WHEN whole THEN start + 3 ELSE start + 1 END AS stop, CASE WHEN whole THEN 'ORG' ELSE 'LETTER' END AS type, CASE WHEN whole THEN 'The' ELSE letter END AS entity FROM c WHERE whole OR regexp_full_match(letter, '[A-Z]'))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS pos, start, CAST(stop AS INTEGER) AS stop, type, entity FROM s""")
def red_offsets(spark, d):
    """Where literals are, of which some lie within others."""
    letters = tuple(chr(c) for c in range(ord("A"), ord("Z") + 1))
    return redaction.entities(table(spark, d, "documents"), redaction.Dictionary({"LETTER": letters, "ORG": ("The",)})).select("doc_id", "pos", "start", "stop", "type", "entity")


@query("red_strict")
def red_strict(spark, d):
    return spans(spark, d, True).select("doc_id", "start", "stop", "type", "entity")


@query("red_mapping", """WITH e AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z]\\w*')) AS w, generate_subscripts(regexp_extract_all(text, '[A-Z]\\w*'), 1) AS pos FROM documents),
f AS (SELECT substr(w, 1, 1) AS entity_type, w AS entity_text, min((doc_id, pos)) AS seen FROM e GROUP BY ALL) SELECT entity_type, entity_text, CAST(row_number() OVER (PARTITION BY entity_type ORDER BY seen) AS INTEGER) AS idx FROM f""")
def red_mapping(spark, d):
    words = table(spark, d, "documents").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[A-Z]\w*"), F.lit(0))).alias("start", "entity"))
    return redaction.mapping(words.withColumn("type", F.substring("entity", 1, 1)))


def redacted(docs: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Redacted texts and the mapping; spans and mapping are stored, as each is used more than once."""
    s = materialise(found, "spans")
    m = materialise(redaction.mapping(s), "mapping")
    return redaction.redact(docs, s, m), m


@query("red_redact")
def red_redact(spark, d):
    return redacted(table(spark, d, "documents").select("doc_id", "text"), spans(spark, d))[0]


@query("red_round_trip", "SELECT doc_id, text FROM documents")
def red_round_trip(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return redaction.restore(*redacted(docs, spans(spark, d, True)))


@query("red_irreversible", "SELECT CAST(-1 AS BIGINT) AS doc_id, '<ORG_1>' AS token")
def irreversible(spark, d):
    s = spans(spark, d)
    docs = table(spark, d, "documents").select("doc_id", "text").unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("doc_id"), F.lit("see <ORG_1> and <NONE_9>").alias("text")))
    return redaction.irreversible(docs, redaction.mapping(s))


@query("red_redact_literals", """WITH o AS (SELECT doc_id, unnest(regexp_extract_all(text, 'Then|The')) AS w, generate_subscripts(regexp_extract_all(text, 'Then|The'), 1) AS i FROM documents),
m AS (SELECT w, row_number() OVER (ORDER BY min((doc_id, i))) AS idx FROM o GROUP BY w), a AS (SELECT max(idx) FILTER (w = 'Then') AS n, max(idx) FILTER (w = 'The') AS e FROM m)
SELECT doc_id, replace(replace(text, 'Then', '<ORG_' || coalesce(n, 0) || '>'), 'The', '<ORG_' || coalesce(e, 0) || '>') AS redacted_text, CAST(len(regexp_extract_all(text, 'Then|The')) AS INTEGER) AS spans_replaced FROM documents, a""")
def red_redact_literals(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return redacted(docs, redaction.entities(docs, redaction.Dictionary({"ORG": ("The", "Then")})))[0]
