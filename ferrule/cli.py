"""Command line over collections stored as Parquet tables: ``python -m ferrule.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.config import available_profiles, load_policy, load_profile
from ferrule.operators import batch, dispatch, evaluation, graph, quality, redaction, tables
from ferrule.plans import search as plans
from ferrule.plans.slots import Slots
from ferrule.sources import tables as sources


def _spark() -> SparkSession:
    spark = SparkSession.builder.appName("ferrule").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _collection(spark: SparkSession, folder: str, profile: str | None) -> plans.Collection:
    structure = load_profile(profile or sources.profile_of(folder)).structure
    return plans.ingest(spark.read.parquet(f"{folder}/pages"), structure)


def _show(df: DataFrame, n: int = 50) -> None:
    df.show(n, truncate=100)


def ingest(a: argparse.Namespace) -> None:
    spark = _spark()
    pages = sources.read_text_files(spark, a.path)
    pages.write.mode("append").parquet(f"{a.collection}/pages")
    sources.set_profile(a.collection, a.profile)
    c = _collection(spark, a.collection, a.profile)
    c.chunks.write.mode("overwrite").parquet(f"{a.collection}/chunks")
    c.edges.write.mode("overwrite").parquet(f"{a.collection}/edges")
    print(f"{c.chunks.count()} chunks")


def search(a: argparse.Namespace) -> None:
    plans.check_request(a.question, a.k)
    spark = _spark()
    q = spark.createDataFrame([(1, a.question)], "query_id int, text string")
    _show(plans.search(_collection(spark, a.collection, None), q, a.k, a.rerank).orderBy("rank").select("rank", "score", "file", "page", "preview"), a.k)


def ask(a: argparse.Namespace) -> None:
    plans.check_request(a.question)
    spark = _spark()
    q = spark.createDataFrame([(1, a.question)], "query_id int, text string")
    row = plans.ask(_collection(spark, a.collection, None), q, Slots()).first()
    print(row["text"])
    print(f"confidence: {row['confidence']}; sources: {', '.join(f'{c['file']} p.{c['page']}' for c in row['citations'] or [])}")


def evaluate(a: argparse.Namespace) -> None:
    spark = _spark()
    cases = sources.read_cases(spark, a.cases).withColumnRenamed("id", "case_id")
    rows, means = plans.evaluate(_collection(spark, a.collection, None), cases, Slots() if a.answer else None)
    sources.write_report(means, rows, a.out, datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ"))
    _show(means)


def eval_compare(a: argparse.Namespace) -> None:
    import json
    from pathlib import Path

    spark = _spark()

    def long(path: str) -> DataFrame:
        body = json.loads(Path(path).read_text(encoding="utf-8"))
        rows = [(None, m, float(v)) for m, v in body["metrics_mean"].items() if v is not None]
        rows += [(c, m, float(v)) for c, ms in body["metrics_by_category"].items() for m, v in ms.items() if v is not None]
        return spark.createDataFrame(rows, "category string, metric string, value double")

    _show(evaluation.compare(long(a.a), long(a.b)).orderBy("category", "metric"), 500)


def batch_ingest(a: argparse.Namespace) -> None:
    """Phase A reads pages into the cache, phase B ingests all that is cached."""
    spark = _spark()
    pages = sources.read_text_files(spark, a.path)
    contents = pages.select("file", F.col("page_num").alias("page"), F.col("text").cast("binary").alias("content"))
    folder = f"{a.checkpoint}-cache"
    cache = sources.read_cache(spark, folder)
    over = None
    try:
        progress = batch.run_batch(contents, sources.read_checkpoint(spark, a.checkpoint), cache, lambda content: (content or b"").decode(), a.cost, a.budget)
    except batch.BudgetExceeded as e:
        over, progress = e, e.progress
    progress.where("status = 'done'").select("key", "text").dropDuplicates(["key"]).write.mode("append").parquet(folder)
    sources.append_checkpoint(progress.select("file", "page", "status", "error_msg", "cost_usd"), a.checkpoint)
    _show(batch.summary(sources.read_checkpoint(spark, a.checkpoint)))
    if a.collection:
        keys = contents.select("file", "page", F.sha2("content", 256).alias("key"))
        found = keys.join(sources.read_cache(spark, folder).dropDuplicates(["key"]), "key").withColumn("status", F.lit("done"))
        c = plans.ingest_read(pages, found, load_profile(a.profile).structure)
        c.chunks.write.mode("overwrite").parquet(f"{a.collection}/chunks")
        c.edges.write.mode("overwrite").parquet(f"{a.collection}/edges")
        pages.write.mode("overwrite").parquet(f"{a.collection}/pages")
        sources.set_profile(a.collection, a.profile)
        _show(plans.counters(c.chunks))
    if over:  # what was read is stored by now
        raise over
    batch.check_errors(progress)


def refs(a: argparse.Namespace) -> None:
    spark = _spark()
    chunks, edges = spark.read.parquet(f"{a.collection}/chunks"), spark.read.parquet(f"{a.collection}/edges")
    if a.type and a.value:
        _show(graph.mentions_of(edges, chunks, a.type, a.value))
    elif a.chunk:
        _show(graph.entities_in(edges, a.chunk))
    else:
        _show(graph.stats(edges, chunks))


def migrate_layout(a: argparse.Namespace) -> None:
    for old, new in sources.migrate_layout(a.root, a.collection, a.apply):
        print(f"{old} -> {new}" + ("" if a.apply else " (dry run)"))


def show_chunks(a: argparse.Namespace) -> None:
    chunks = _spark().read.parquet(f"{a.collection}/chunks")
    print(f"{chunks.count()} chunks")
    _show(chunks.orderBy("ord").select("chunk_id", "chunk_type", "page", "text"), a.n)


def _rules(a: argparse.Namespace) -> list[quality.Rule]:
    return [quality.parse_rule(r, True) for r in a.flag_below] + [quality.parse_rule(r, False) for r in a.flag_above]


def ocr_quality(a: argparse.Namespace) -> None:
    rows = quality.report_rows(_spark().read.json(a.metrics))
    _show(quality.flagged(rows, _rules(a)))
    _show(quality.summary(rows))


def ocr_gallery(a: argparse.Namespace) -> None:
    raw = _spark().read.json(a.metrics)
    worst = quality.gallery(quality.report_rows(raw), _rules(a), a.limit)
    sources.write_gallery(worst.join(raw.select("page_key", "text"), "page_key").orderBy(F.desc("margin"), "page_key"), a.out)


def redact_preview(a: argparse.Namespace) -> None:
    spark = _spark()
    docs = spark.read.text(a.path, wholetext=True).select(F.lit(1).alias("doc_id"), F.col("value").alias("text"))
    spans = redaction.entities(docs, redaction.load_dictionary(a.dictionary), a.strict)
    row = redaction.redact(docs, spans, redaction.mapping(spans)).first()
    print(row["redacted_text"])
    print(f"{row['spans_replaced']} spans replaced", file=sys.stderr)


def dispatch_plan(a: argparse.Namespace) -> None:
    spark = _spark()
    pages = sources.read_text_files(spark, a.path).withColumn("content", F.col("text"))
    plan = dispatch.plan(pages, a.pool.split(","), a.task)
    _show(plan)
    _show(dispatch.counts(plan, a.pool.split(",")))
    if a.provenance:
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        records = plan.select("content_hash", "provider", F.lit(now).alias("assigned_at"), "task_kind", F.lit(None).cast("boolean").alias("redaction_applied"), F.lit("").alias("notes"))
        print(f"{sources.append_provenance(records, a.provenance)} records added")


def table_preview(a: argparse.Namespace) -> None:
    cells = tables.cells(_spark().read.json(a.tables))
    for row in tables.markdown(cells).toLocalIterator():
        print(row["md"], end="\n\n")


def policy_trace(a: argparse.Namespace) -> None:
    signals = sources.read_signals(_spark(), *a.signals)
    if a.diff:
        _show(quality.flips(signals, load_policy(a.policy), load_policy(a.diff)))
    else:
        traces = quality.trace(signals, load_policy(a.policy))
        _show(traces)
        _show(quality.trace_counts(traces))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="ferrule")
    sub = out.add_subparsers(required=True)

    def command(f, *arguments: tuple) -> None:
        p = sub.add_parser(f.__name__.replace("_", "-"))
        for names, options in arguments:
            p.add_argument(*names.split(), **options)
        p.set_defaults(run=f)

    where = ("collection", {})
    flags = [("--flag-below", {"action": "append", "default": []}), ("--flag-above", {"action": "append", "default": []})]
    command(ingest, where, ("path", {}), ("--profile", {"default": "contract", "choices": available_profiles()}))
    command(search, where, ("question", {}), ("--k", {"type": int, "default": 5}), ("--rerank", {"action": "store_true"}))
    command(ask, where, ("question", {}))
    command(evaluate, where, ("cases", {}), ("--out", {"default": "reports"}), ("--answer", {"action": "store_true"}))
    command(eval_compare, ("a", {}), ("b", {}))
    command(batch_ingest, ("path", {}), ("checkpoint", {}), ("--budget", {"type": float, "default": 100.0}), ("--cost", {"type": float, "default": 0.002}), ("--collection", {}), ("--profile", {"default": "contract", "choices": available_profiles()}))
    command(refs, where, ("--type", {"choices": graph.TYPES}), ("--value", {}), ("--chunk", {}))
    command(migrate_layout, ("root", {}), where, ("--apply", {"action": "store_true"}))
    command(show_chunks, where, ("--n", {"type": int, "default": 10}))
    command(ocr_quality, ("metrics", {}), *flags)
    command(ocr_gallery, ("metrics", {}), ("out", {}), ("--limit", {"type": int, "default": 20}), *flags)
    command(redact_preview, ("path", {}), ("dictionary", {}), ("--strict", {"action": "store_true"}))
    command(dispatch_plan, ("path", {}), ("pool", {}), ("--task", {"default": "ocr"}), ("--provenance", {}))
    command(table_preview, ("tables", {}))
    command(policy_trace, ("signals", {"nargs": "+"}), ("--policy", {"default": "default"}), ("--diff", {}))
    return out


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main()
