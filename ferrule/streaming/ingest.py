"""Streams: pages that arrive are chunked and upserted; logs are kept free of repeats.

An addition of this engine; batch plans do the same over whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ferrule.config import CONTRACT_STRUCTURE, Structure
from ferrule.operators.chunking import chunk_pages


def page_stream(spark, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def chunk_stream(pages: DataFrame, out: str, checkpoint: str, structure: Structure = CONTRACT_STRUCTURE) -> StreamingQuery:
    """Chunk each micro-batch of whole files and append it under its batch number, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        chunk_pages(batch, structure).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_records(records: DataFrame, time: str = "assigned_ts", delay: str = "1 hour") -> DataFrame:
    """Provenance records as they come, each key once within the delay."""
    return records.withWatermark(time, delay).dropDuplicatesWithinWatermark(["content_hash", "task_kind", "provider"])


def progress_windows(progress: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Pages by status and their cost in windows of time; late rows count until the watermark passes."""
    return progress.withWatermark("ts", delay).groupBy(F.window("ts", width), "status").agg(F.count("*").alias("pages"), F.sum("cost_usd").alias("cost_usd"))
