"""Reading and writing the tables of a collection: snapshots, cases, logs, caches, reports."""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrule.functions.text import strip
from ferrule.operators.dispatch import new_records
from ferrule.schema import CHECKPOINT, CHUNK, EVAL_CASE, PROVENANCE, SIGNAL

DEFAULT_PROFILE = "contract"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(stored: DataFrame) -> DataFrame:
    """A stored table dealt to all cores, if its files make fewer partitions than there are cores."""
    cores = stored.sparkSession.sparkContext.defaultParallelism
    return stored.repartition(cores) if stored.rdd.getNumPartitions() < cores else stored


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """A chunk snapshot of JSON lines; none is an empty table. A box may be stored as a list."""
    if not _exists(spark, path):
        return spark.createDataFrame([], CHUNK)
    raw = spark.read.schema(CHUNK.replace("bbox struct<x0:double,y0:double,x1:double,y1:double>", "bbox string")).json(path)
    listed, named = F.from_json("bbox", "array<double>"), F.from_json("bbox", "struct<x0:double,y0:double,x1:double,y1:double>")
    box = F.when(F.col("bbox").startswith("["), F.struct(*(listed[i].alias(k) for i, k in enumerate(("x0", "y0", "x1", "y1"))))).otherwise(named)
    return raw.withColumn("bbox", F.when(F.col("bbox").isNotNull(), box))


def append_chunks(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("append").json(path, ignoreNullFields=False)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of JSON lines; blank lines and ``#`` comments are passed over."""
    lines = spark.read.text(path).where((strip(F.col("value")) != "") & ~strip(F.col("value")).startswith("#"))
    return lines.select(F.from_json("value", EVAL_CASE).alias("c")).select("c.*")


def read_signals(spark: SparkSession, *paths: str) -> DataFrame:
    """Signal records of several files with ``ord``: the order of files, and of lines within them."""

    def one(i: int, path: str) -> DataFrame:
        lines = spark.read.text(path).withColumn("_line", F.monotonically_increasing_id())
        return lines.where(strip(F.col("value")) != "").select(F.lit(i).alias("_file"), "_line", F.from_json("value", SIGNAL).alias("s"))

    rows = reduce(DataFrame.unionByName, (one(i, p) for i, p in enumerate(paths)))
    return rows.select(F.struct("_file", "_line").alias("ord"), "s.*")


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """Progress rows; lines that are no JSON (a torn last one) are passed over."""
    if not _exists(spark, path):
        return spark.createDataFrame([], CHECKPOINT)
    raw = spark.read.text(path).select(F.from_json("value", f"{CHECKPOINT}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    return raw.where("r IS NOT NULL AND r._corrupt IS NULL AND r.file IS NOT NULL").select("r.*").drop("_corrupt")


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """``key, text`` of the pages that have been read; empty if there is no cache yet."""
    return spark.read.parquet(path) if _exists(spark, path) else spark.createDataFrame([], "key string, text string")


def append_checkpoint(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path, ignoreNullFields=False)


def append_provenance(offered: DataFrame, path: str) -> int:
    """Append the records that are not there yet; how many."""
    spark = offered.sparkSession
    known = spark.read.schema(PROVENANCE).json(path) if _exists(spark, path) else spark.createDataFrame([], PROVENANCE)
    fresh = new_records(known, offered)
    n = fresh.count()
    if n:
        fresh.write.mode("append").json(path, ignoreNullFields=False)
    return n


def cache_key(content, kind: str = "", suffixes: tuple[str, ...] = ()):
    """The key of a page's reading: its SHA-256, and what else the reading depends on."""
    digest = F.sha2(content.cast("binary"), 256)
    return F.concat(digest, F.lit("".join([f".{kind}" if kind else "", *suffixes, ".txt"])))


def caption_key(image, model: str, profile: str | None = None):
    """The key of a caption: image, model and profile."""
    tail = F.lit(f"{model}caption" + (f"[{profile}]" if profile else "")).cast("binary")
    return F.sha2(F.concat(image.cast("binary"), tail), 256)


def merge_cache(cache: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """A cache with fresh entries; what is there is never rewritten."""
    return cache.unionByName(fresh.join(cache.select(*keys), keys, "left_anti").dropDuplicates(keys))


def write_report(means: DataFrame, per_case: DataFrame, path: str, timestamp: str) -> None:
    """An evaluation report: means as one JSON file with sorted keys, cases as JSON lines."""
    rows = [r.asDict(recursive=True) for r in means.toLocalIterator()]  # a row a category
    body = {"timestamp": timestamp, "n_cases": next((r["n_cases"] for r in rows if r["overall"]), 0)}
    pick = lambda r: {k: v for k, v in r.items() if k not in ("overall", "category", "n_cases")}
    body["metrics_mean"] = next((pick(r) for r in rows if r["overall"]), {})
    body["metrics_by_category"] = {r["category"]: pick(r) | {"n_cases": r["n_cases"]} for r in rows if not r["overall"]}
    Path(path).mkdir(parents=True, exist_ok=True)
    Path(path, f"{timestamp}.json").write_text(json.dumps(body, indent=2, sort_keys=True, ensure_ascii=False), encoding="utf-8")
    per_case.write.mode("overwrite").json(f"{path}/{timestamp}-cases")


def write_gallery(pages: DataFrame, path: str) -> None:
    """An index of flagged pages, worst first, and each page's text; the gallery's limit bounds it."""
    from ferrule.functions.text import gallery_preview

    Path(path).mkdir(parents=True, exist_ok=True)
    lines = ["| page | margin | reasons | text |", "|---|---|---|---|"]
    for r in pages.withColumn("_p", gallery_preview(F.col("text"))).toLocalIterator():
        Path(path, f"{r['page_key']}.txt").write_text(r["text"] or "", encoding="utf-8")
        lines.append(f"| {r['page_key']} | {r['margin']:.4f} | {'; '.join(r['flag_reasons'])} | {r['_p']} |")
    Path(path, "index.md").write_text("\n".join(lines) + "\n", encoding="utf-8")


def write_elements(elements: DataFrame, path: str) -> None:
    elements.select("jsonl").write.mode("overwrite").text(path)


def pages_of(documents: DataFrame, per_file: int = 400) -> DataFrame:
    """Documents as pages of files: a source's ids in runs of ``per_file``."""
    file = F.concat_ws("-", "source", F.floor(F.col("doc_id") / per_file).cast("string"))
    number = F.row_number().over(Window.partitionBy("file").orderBy("doc_id"))
    return documents.withColumn("file", file).select("file", number.alias("page_num"), "doc_id", "text", F.lit("text").alias("page_kind"))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row a page of plain-text files, pages parted by form feeds; a page that cannot be read is empty."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.try_validate_utf8(F.col("content").cast("string")).alias("t"))
    pages = files.select("file", F.posexplode(F.split(F.coalesce("t", F.lit("")), "\f")).alias("p", "text"))
    return pages.select("file", (F.col("p") + 1).cast("int").alias("page_num"), "text", F.array().cast("array<string>").alias("tables"), F.lit("text").alias("page_kind"), F.lit(0).alias("rotation"))


def profile_of(folder: str) -> str:
    """The profile that a collection was built with."""
    path = Path(folder, "profile")
    return path.read_text(encoding="utf-8").strip() if path.exists() else DEFAULT_PROFILE


def set_profile(folder: str, name: str) -> None:
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, "profile").write_text(name + "\n", encoding="utf-8")


LEGACY = ("chunks.jsonl", "refs.db", "mapping.jsonl", "profile")


def migrate_layout(root: str, collection: str, apply: bool = False) -> list[tuple[str, str]]:
    """Moves that bring loose files into a collection's folder; nothing is overwritten."""
    moves = [(Path(root, n), Path(root, collection, n)) for n in LEGACY]
    moves = [(a, b) for a, b in moves if a.exists() and not b.exists()]
    if apply:
        for a, b in moves:
            b.parent.mkdir(parents=True, exist_ok=True)
            a.rename(b)
    return [(str(a), str(b)) for a, b in moves]
