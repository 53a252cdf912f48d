"""Places for models and services, with deterministic stand-ins.

Each slot is a function from columns to a column, or from a table to a table, so
that a model is a pandas UDF away and plans stay the same.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.functions.text import sentences, words
from ferrule.operators import images, ruled, vector
from ferrule.operators.citations import extractive_answer
from ferrule.operators.evaluation import question_share, supported_share
from ferrule.operators.fusion import overlap_score
from ferrule.sources.scratch import materialise
from ferrule.sources.tables import caption_key


def no_caption(image: Column, nearby: Column) -> Column:
    """The caption of a page that no model saw: empty, which is not the same as none."""
    return F.lit("")


@dataclass(frozen=True)
class Slots:
    #: A page table from a path.
    parse: Callable[[object, str], DataFrame] | None = None
    #: ``struct<text, scores>`` of a page image; null where the engine failed.
    ocr: Callable[[Column], Column] | None = None
    caption: Callable[[Column, Column], Column] = no_caption
    embed: Callable[[Column], Column] = vector.hash_embedding
    tokenise: Callable[[Column], Column] = words
    rerank: Callable[[Column, Column], Column] = overlap_score
    answer: Callable[[DataFrame, DataFrame], DataFrame] = extractive_answer
    #: Tables of a page image: of each the ``html, boxes, logic`` that ``tables.cells`` takes.
    structure: Callable[[Column], Column] = ruled.structure
    #: An image of a page of a file, at so many dots an inch.
    render: Callable[[Column, Column, int], Column] | None = None
    turn: Callable[[Column, Column], Column] = images.turn
    relevancy: Callable[[Column, Column], Column] = question_share
    faithfulness: Callable[[Column, Column], Column] = field(default=lambda answer, passages: supported_share(sentences(answer), passages))


def row_udf(f: Callable[..., object], kind: str) -> Callable[..., Column]:
    """A Python function of single values as a slot, in Arrow batches; a row that fails is null."""

    def run(*columns: pd.Series) -> pd.Series:
        def one(*values: object) -> object:
            try:
                return f(*values)
            except Exception:  # one page must not fail the job
                return None

        return pd.Series([one(*v) for v in zip(*columns, strict=True)])

    run.__annotations__ = {"columns": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, kind)


def base_url(address: str) -> str:
    """The root of a model server's interface: its address with one ``/v1`` at the end."""
    bare = address.rstrip("/")
    return bare if bare.endswith("/v1") else bare + "/v1"


def upright(images: DataFrame, rotations: DataFrame | None, slots: Slots) -> DataFrame:
    """Page images (``file, page, image``), turned by what is known of their pages (``file, page, rotation``)."""
    if rotations is None:
        return images
    known = rotations.select("file", "page", "rotation").dropDuplicates(["file", "page"])
    joined = images.join(known, ["file", "page"], "left")
    return joined.withColumn("image", F.when(F.coalesce("rotation", F.lit(0)) == 0, F.col("image")).otherwise(slots.turn(F.col("image"), F.col("rotation")))).drop("rotation")


def cached_captions(wanted: DataFrame, cache: DataFrame, slots: Slots) -> tuple[DataFrame, DataFrame]:
    """``wanted`` (``key, image, nearby``) with ``caption``, and the cache's new rows (``key, payload``).

    A cached payload is UTF-8; an empty one is a caption like any other, one that
    is not UTF-8 is a miss.  A caption that failed is null, and not cached.
    """
    held = cache.select("key", F.try_validate_utf8(F.col("payload").cast("string")).alias("_held")).where("_held IS NOT NULL").dropDuplicates(["key"])
    joined = wanted.join(held, "key", "left")
    hits = joined.where("_held IS NOT NULL").select(*wanted.columns, F.col("_held").alias("caption"))
    fresh = materialise(joined.where("_held IS NULL").select(*wanted.columns, slots.caption(F.col("image"), F.substring("nearby", 1, 1500)).alias("caption")), "captions")
    new = fresh.where("caption IS NOT NULL").select("key", F.col("caption").cast("binary").alias("payload")).dropDuplicates(["key"])
    return hits.unionByName(fresh), new


#: What keys of pages without an image begin with.
_BARE = "no image"


def captioned(chunks: DataFrame, images: DataFrame, slots: Slots, rotations: DataFrame | None = None, cache: DataFrame | None = None, model: str = "", profile: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``chunks``, drawing chunks with the caption of their page, and the caption cache's new rows (``key, payload``).

    A drawn page (``images``: ``file, page, image``) is turned upright, looked up in the
    ``cache`` by image, model and profile, and read once if it is not there; pages with
    one image are one.  A page without an image goes by its text alone, and is not
    cached; one whose captioner failed has an empty caption; chunks of other kinds
    keep theirs.
    """
    drawn = chunks.where("chunk_type = 'drawing'").groupBy("file", "page").agg(F.min_by("text", "ord" if "ord" in chunks.columns else "text").alias("nearby"))
    pages = drawn.join(upright(images, rotations, slots), ["file", "page"], "left")
    bare = F.concat_ws(" ", F.lit(_BARE), "file", "page")
    keyed = materialise(pages.select("file", "page", "image", "nearby", F.coalesce(caption_key(F.col("image"), model, profile), bare).alias("key")), "drawn-pages")
    first = keyed.groupBy("key").agg(F.min(F.struct("file", "page")).alias("p")).select("key", "p.*")
    once = keyed.join(first, ["key", "file", "page"], "left_semi").select("key", "image", "nearby")
    none = chunks.sparkSession.createDataFrame([], "key string, payload binary")
    found, new = cached_captions(once, none if cache is None else cache, slots)
    captions = keyed.select("file", "page", "key").join(found.select("key", F.col("caption").alias("_caption")), "key").drop("key")
    joined = chunks.join(captions, ["file", "page"], "left")
    out = joined.withColumn("caption", F.when(F.col("chunk_type") == "drawing", F.coalesce("_caption", F.lit(""))).otherwise(F.col("caption"))).select(*chunks.columns)
    return out, new.where(~F.col("key").startswith(_BARE))


def attach_captions(chunks: DataFrame, images: DataFrame, slots: Slots, rotations: DataFrame | None = None) -> DataFrame:
    """``captioned`` without a cache."""
    return captioned(chunks, images, slots, rotations)[0]


def caption_prompt(template: str, nearby: Column) -> Column:
    """A captioner's prompt; doubled braces in the template are single ones."""
    text = template.replace("{{", "{").replace("}}", "}")
    return F.replace(F.lit(text), F.lit("{nearby_text}"), F.substring(nearby, 1, 1500))
