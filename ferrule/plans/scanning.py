"""Reading page images: the cache first, then a cheap reading, and dear ones only for pages that need them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.config import Policy
from ferrule.operators import quality
from ferrule.plans.slots import Slots
from ferrule.sources.scratch import materialise

#: Fixed value: dots an inch of the plain reading.
DPI = 150
READING = "struct<text:string,scores:array<double>>"
#: A page's reading as a cache keeps it.
CACHE = "key string, text string, scores array<double>, rotation int, refined boolean"


@dataclass(frozen=True)
class Reader:
    """What a reading depends on besides the image; part of its cache key."""

    kind: str
    model: str = ""
    profile: str = ""
    #: Pages of a file that are read at most.
    max_pages: int | None = None
    rotate: bool = True
    rescue: bool = True

    def suffix(self) -> str:
        gates = ("+turn" if self.rotate else "") + ("+fine" if self.rescue else "")
        return "|".join(("", self.kind, self.model, self.profile, gates))


def read_pages(pages: DataFrame, reader: Reader, slots: Slots, cache: DataFrame | None = None, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """The readings of ``pages`` (``file, page`` and, unless ``slots.render`` makes it, ``image``), and the rows that are new to the cache (``CACHE``).

    Readings have ``file, page, key, text, scores, rotation, refined, source``.
    ``source`` is ``cache``, ``plain``, ``probed`` (read in all four turns as it read badly
    upright) or ``empty`` for a page that has no image or that the engine failed on.

    Each step gets the survivors of the one before: images of one content are read
    once, in the cache never; only pages whose plain reading fails the policy's
    gate are turned and read again; only those that read badly in their best turn
    are rendered anew at ``policy.rescue_dpi``, and the finer reading stands if it has
    more in it.  A step is stored, so that no reading is made twice.  Empty
    readings are not cached, so that they are tried again.
    """
    if slots.ocr is None:
        raise ValueError("there is no engine to read with: set Slots.ocr")
    if reader.max_pages is not None:
        pages = pages.where(F.col("page") <= reader.max_pages)
    if "image" in pages.columns:
        images = pages.select("file", "page", "image")
    else:  # a page is rendered once
        images = materialise(pages.select("file", "page", slots.render(F.col("file"), F.col("page"), DPI).alias("image")), "rendered")
    digest = F.concat(F.sha2(F.coalesce(F.col("image").cast("binary"), F.lit(b"")), 256), F.lit(reader.suffix()))
    keyed = materialise(images.select("file", "page", digest.alias("key"), F.col("image").isNull().alias("none")), "page-keys")  # narrow

    if keyed.groupBy("file", "page").count().where("count > 1").limit(1).count():
        raise ValueError("a page is listed twice")
    held = keyed.sparkSession.createDataFrame([], CACHE) if cache is None else cache.select("key", "text", "scores", "rotation", "refined").dropDuplicates(["key"])
    missing = keyed.where("not none").join(held.select("key"), "key", "left_anti")
    first = materialise(missing.groupBy("key").agg(F.min(F.struct("file", "page")).alias("p")).select("key", "p.*"), "to-read")  # one page a content
    to_read = images.join(first, ["file", "page"])
    plain = materialise(to_read.select("key", "file", "page", slots.ocr(F.col("image")).cast(READING).alias("r")).select("key", "file", "page", "r.text", "r.scores"), "plain")

    best = plain.where("scores IS NOT NULL").select("key", "file", "page", "text", "scores", F.lit(0).alias("rotation"), F.lit("plain").alias("source"))
    if reader.rotate:
        best = _probed(best, images, slots, policy)
    if reader.rescue:
        best = _rescued(best, images, slots, policy)
    else:
        best = best.withColumn("refined", F.lit(False))
    best = materialise(best.select("key", "text", "scores", "rotation", "refined", "source"), "readings")

    known = best.unionByName(held.withColumn("source", F.lit("cache")))
    out = keyed.join(known, "key", "left").select("file", "page", "key", "text", "scores", F.coalesce("rotation", F.lit(0)).alias("rotation"), F.coalesce("refined", F.lit(False)).alias("refined"), F.coalesce("source", F.lit("empty")).alias("source"))
    return out, best.where("trim(coalesce(text, '')) <> ''").drop("source")


def _probed(upright: DataFrame, images: DataFrame, slots: Slots, policy: Policy) -> DataFrame:
    """The readings, of pages that fail the gate those of their best turn."""
    good = F.coalesce(F.array_min("scores") >= policy.gate_min_score, F.lit(False))
    bad = materialise(upright.where(~good), "badly-read")
    turns = images.join(bad.select("key", "file", "page"), ["file", "page"]).withColumn("rotation", F.explode(F.array(*(F.lit(r) for r in quality.ROTATIONS if r))))
    turned = turns.select("key", "file", "page", "rotation", slots.ocr(slots.turn(F.col("image"), F.col("rotation"))).cast(READING).alias("r"))
    probes = materialise(turned.select("key", "file", "page", "rotation", F.coalesce("r.text", F.lit("")).alias("text"), F.coalesce("r.scores", F.array().cast("array<double>")).alias("scores")), "probes")
    probes = probes.unionByName(bad.select(*probes.columns))
    chosen = quality.best_rotation(probes.withColumnRenamed("key", "page_key"), policy).select(F.col("page_key").alias("key"), "rotation")
    return upright.where(good).unionByName(probes.join(chosen, ["key", "rotation"]).withColumn("source", F.lit("probed")))


def _rescued(readings: DataFrame, images: DataFrame, slots: Slots, policy: Policy) -> DataFrame:
    """The readings, of pages that still read badly the finer one if it has more in it."""
    rows = materialise(readings, "turned")
    poor = F.coalesce((F.size("scores") == 0) | (F.array_min("scores") < policy.rescue_min_score), F.lit(False))
    need = rows.where(poor)
    if slots.render is None:  # the page as it is must do: there is nothing finer to read
        return rows.withColumn("refined", F.lit(False))
    image = slots.turn(slots.render(F.col("file"), F.col("page"), policy.rescue_dpi), F.col("rotation"))
    finer = need.select("key", slots.ocr(image).cast(READING).alias("r"))
    finer = materialise(finer.select("key", F.col("r.text").alias("fine_text"), F.coalesce("r.scores", F.array().cast("array<double>")).alias("fine_scores")), "finer")
    both = need.join(finer, "key")
    pairs = both.select(
        F.col("key").alias("page_key"), F.size("scores").alias("boxes"), F.array_min("scores").alias("min_score"),
        quality.mass(F.coalesce("text", F.lit("")), F.col("scores")).alias("mass"), quality.mass(F.coalesce("fine_text", F.lit("")), F.col("fine_scores")).alias("rescue_mass"),
    )
    wins = quality.rescue(pairs, policy).select(F.col("page_key").alias("key"), "use_rescue")
    settled = both.join(wins, "key").withColumns({"text": F.when(F.col("use_rescue"), F.col("fine_text")).otherwise(F.col("text")), "refined": F.col("use_rescue")})
    return rows.where(~poor).withColumn("refined", F.lit(False)).unionByName(settled.select(*rows.columns, "refined"))


def as_pages(readings: DataFrame) -> DataFrame:
    """Readings as the pages that ``search.ingest`` takes; a page that was not read is empty."""
    return readings.select("file", F.col("page").cast("int").alias("page_num"), F.coalesce("text", F.lit("")).alias("text"), F.array().cast("array<string>").alias("tables"), F.lit("text").alias("page_kind"), "rotation")
