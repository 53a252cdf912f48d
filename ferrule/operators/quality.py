"""Page quality: metrics, flags, routing, rotation and rescue decisions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.config import Policy
from ferrule.functions.numbers import fixed, general, rounded
from ferrule.functions.text import WS, char_ratios

#: Fixed values.
LOW_SCORE = 0.7
SIGNALS = ("boxes", "mean_score", "min_score", "low_score_ratio", "non_alnum_ratio", "garbled_ratio", "n_columns", "max_band_gap", "box_coverage", "order_divergence")
ROTATIONS = (0, 90, 180, 270)


def page_metrics(boxes: DataFrame, texts: DataFrame) -> DataFrame:
    """Per page of ``texts`` (``page_key, text``): box scores and character shares; what there is no evidence of is null."""
    scores = boxes.groupBy("page_key").agg(
        F.count("score").alias("boxes"), F.avg("score").alias("mean_score"), F.min("score").alias("min_score"), F.avg((F.col("score") < LOW_SCORE).cast("int")).alias("low_score_ratio")
    )
    ratios = char_ratios(F.col("text"))
    out = texts.select("page_key", ratios["alnum"].alias("alnum_ratio"), ratios["garbled"].alias("garbled_ratio")).join(scores, "page_key", "left")
    return out.withColumn("boxes", F.coalesce("boxes", F.lit(0)))


def report_rows(metrics: DataFrame) -> DataFrame:
    """Metrics as a report shows them: four decimals, ``non_alnum_ratio`` in place of the alnum share; signals a record lacks are null."""
    has = lambda c: F.col(c) if c in metrics.columns else F.lit(None).cast("double")
    error = F.col("engine_error") if "engine_error" in metrics.columns else F.lit(None).cast("string")
    metric = [rounded(has(c), 4).alias(c) for c in ("mean_score", "min_score", "low_score_ratio", "garbled_ratio", "max_band_gap", "box_coverage", "order_divergence")]
    return metrics.select("page_key", "boxes", rounded(1 - F.col("alnum_ratio"), 4).alias("non_alnum_ratio"), has("n_columns").cast("int").alias("n_columns"), *metric, error.alias("engine_error"))


@dataclass(frozen=True)
class Rule:
    signal: str
    threshold: float
    below: bool

    def hit(self) -> Column:
        c = F.col(self.signal)
        return F.coalesce(c < self.threshold if self.below else c > self.threshold, F.lit(False))

    def reason(self) -> Column:
        """``signal=value<threshold``; numbers in the shortest form of six digits."""
        sign = "<" if self.below else ">"
        return F.concat(F.lit(f"{self.signal}="), general(F.col(self.signal).cast("double")), F.lit(f"{sign}{self.threshold:g}"))

    def margin(self) -> Column:
        c = F.col(self.signal)
        return F.when(self.hit(), self.threshold - c if self.below else c - self.threshold)


def parse_rule(text: str, below: bool) -> Rule:
    """``<signal>:<value>``."""
    signal, _, value = text.partition(":")
    if signal not in SIGNALS:
        raise ValueError(f"unknown signal {signal!r}; there are: {', '.join(SIGNALS)}")
    try:
        number = float(value)
    except ValueError:
        raise ValueError(f"{text!r}: not a number after the colon") from None
    if math.isnan(number):
        raise ValueError(f"{text!r}: not a number after the colon")
    return Rule(signal, number, below)


def flagged(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` with ``flagged``, ``flag_reasons`` and ``margin``, by how much the worst rule is broken."""
    reasons = F.array_compact(F.array(*(F.when(r.hit(), r.reason()) for r in rules))) if rules else F.array().cast("array<string>")
    margins = [r.margin() for r in rules]
    margin = F.greatest(*margins) if len(margins) > 1 else margins[0] if margins else F.lit(None).cast("double")
    return rows.withColumns({"flag_reasons": reasons, "flagged": F.size(reasons) > 0, "margin": margin})


def gallery(rows: DataFrame, rules: list[Rule], limit: int) -> DataFrame:
    """The flagged pages, worst first."""
    if not rules:
        raise ValueError("a gallery needs at least one rule")
    return flagged(rows, rules).where("flagged").orderBy(F.desc("margin"), "page_key").limit(limit)


def summary(rows: DataFrame, signals: tuple[str, ...] = SIGNALS) -> DataFrame:
    """``signal, mean, min, max, n_defined``, in one pass over the rows."""
    long = rows.select(*(F.col(s).cast("double").alias(s) for s in signals)).unpivot([], list(signals), "signal", "value")
    return long.groupBy("signal").agg(F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count("value").alias("n_defined"))


def classify_pixels(dark: Column, strong_rows: Column) -> Column:
    """The route by ink alone: nearly empty, nearly full or without lines of writing is a drawing. Fixed values."""
    return F.when((dark < 0.005) | (dark > 0.5) | (strong_rows < 0.08), "drawing").otherwise("text")


def classify_boxes(boxes: Column, coverage: Column, dark: Column, policy: Policy, fallback: Column | None = None) -> Column:
    """``route, reason`` by boxes first; rules on ink do not apply where it is not known. The reasons' wording is fixed."""
    fallback = F.lit("text") if fallback is None else fallback
    none = boxes.isNull() | coverage.isNull()
    empty = boxes == 0
    filled = dark > policy.v2_filled_dark_ratio
    sparse = (coverage < policy.v2_sparse_cover) & (dark < policy.v2_sparse_dark)
    fragments = coverage / F.nullif(boxes, F.lit(0)) < policy.v2_fragment_box_frac
    route = F.when(none, fallback).when(empty, "drawing").when(filled, "drawing").when(sparse, "text").when(fragments, "drawing").otherwise("text")
    reason = (
        F.when(none, F.concat(F.lit("no-box-signals -> fallback-v1 (v1="), fallback, F.lit(")")))
        .when(empty, "boxes==0 (no text -> graphical)")
        .when(filled, F.concat(F.lit("dark "), fixed(dark, 3), F.lit(f" > {policy.v2_filled_dark_ratio} (filled)")))
        .when(sparse, F.concat(F.lit("sparse cov "), fixed(coverage, 3), F.lit(f" < {policy.v2_sparse_cover} (title/divider)")))
        .when(fragments, F.concat(F.lit("frag "), fixed(coverage / F.nullif(boxes, F.lit(0)), 5), F.lit(f" < {policy.v2_fragment_box_frac} (spec/map/chart)")))
        .otherwise("default -> text")
    )
    return F.struct(route.alias("route"), reason.alias("reason"))


def trace(signals: DataFrame, policy: Policy) -> DataFrame:
    """``signals`` (``page_num, boxes, box_coverage, dark_ratio``) with their route, its reason and the derived signals."""
    verdict = classify_boxes(F.col("boxes"), F.col("box_coverage"), F.col("dark_ratio"), policy)
    area = F.when(F.col("boxes") > 0, rounded(F.col("box_coverage") / F.nullif("boxes", F.lit(0)), 6))
    return signals.withColumns({"route": verdict["route"], "reason": verdict["reason"], "mean_box_area": area, "dark": rounded(F.col("dark_ratio"), 4), "v2_toggle": F.lit(policy.needs_vision_v2)})


def trace_counts(traces: DataFrame) -> DataFrame:
    one = lambda r: F.count_if(F.col("route") == r).alias(f"n_{r}")
    return traces.agg(one("drawing"), one("text"))


def flips(signals: DataFrame, a: Policy, b: Policy) -> DataFrame:
    """The pages whose route two policies see differently.

    Both are judged on the same row: page numbers may repeat over files, and no
    join is needed to match them.
    """
    of = lambda p: classify_boxes(F.col("boxes"), F.col("box_coverage"), F.col("dark_ratio"), p)
    both = signals.withColumns({"_a": of(a), "_b": of(b)}).where("_a.route <> _b.route")
    return both.select(*signals.columns, F.col("_a.route").alias("route_a"), F.col("_b.route").alias("route_b"), F.col("_a.reason").alias("reason_a"), F.col("_b.reason").alias("reason_b"))


def flips_by_position(a: DataFrame, b: DataFrame) -> DataFrame:
    """Flips of two traces that were stored apart, row by row (``ord``); they must be of one length."""
    if a.count() != b.count():
        raise ValueError("the traces are of different length: both policies must trace the same source")
    both = a.select("ord", F.col("route").alias("route_a")).join(b.select("ord", F.col("route").alias("route_b")), "ord")
    return both.where("route_a <> route_b")


def solid_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[{WS}]", ""))


def mass(text: Column, scores: Column) -> Column:
    """Characters times their mean score; 0 without scores."""
    n = F.size(scores)
    return F.when(n > 0, solid_chars(text) * F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)


def probe_rows(probes: DataFrame) -> DataFrame:
    """Evidence of each probe (``page_key, rotation, text, scores``)."""
    n = F.nullif(F.size("scores"), F.lit(0))
    mean = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x) / n
    return probes.select(
        "page_key", "rotation", F.size("scores").alias("boxes"), solid_chars(F.col("text")).alias("chars"), rounded(mean, 4).alias("mean_score"),
        rounded(F.array_min("scores"), 4).alias("min_score"), rounded(mass(F.col("text"), F.col("scores")), 1).alias("mass"),
    )


def best_rotation(probes: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """``page_key, rotation, gated``: upright unless the page reads badly and another turn reads clearly better."""
    m = mass(F.col("text"), F.col("scores"))
    rows = probes.select("page_key", "rotation", m.alias("mass"), F.array_min("scores").alias("low"))
    base = F.max_by(F.struct("mass", "low"), F.col("rotation") == 0).alias("base")
    best = F.max(F.struct("mass", (-F.col("rotation")).alias("turn"))).alias("best")
    out = rows.groupBy("page_key").agg(base, best)
    good = F.coalesce(F.col("base.low") >= policy.gate_min_score, F.lit(False))
    clear = F.col("best.mass") > F.col("base.mass") * policy.improvement_factor
    return out.select("page_key", F.when(good | ~clear, 0).otherwise(-F.col("best.turn")).alias("rotation"), (~good).alias("gated"))


def rescue(pairs: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """``page_key, use_rescue``: whether a second reading at a finer resolution wins (``boxes, min_score, mass, rescue_mass``); without metrics there is none."""
    gate = F.col("boxes").isNotNull() & ((F.col("boxes") == 0) | (F.col("min_score") < policy.rescue_min_score))
    return pairs.select("page_key", F.coalesce(gate & (F.col("rescue_mass") > F.col("mass")), F.lit(False)).alias("use_rescue"))


def scan(metrics: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Stored metrics where there are any, fresh ones elsewhere; of a page that its engine failed on (``engine_error``) no signal counts."""
    fresh = metrics.join(sidecars.select("page_key"), "page_key", "left_anti")
    if "engine_error" in metrics.columns:
        rest = [c for c in metrics.columns if c not in ("page_key", "file", "page", "engine_error")]
        fresh = fresh.withColumns({c: F.when(F.col("engine_error").isNull(), F.col(c)) for c in rest})
    return sidecars.unionByName(fresh, allowMissingColumns=True)


def storable(scanned: DataFrame, sidecars: DataFrame) -> DataFrame:
    """The rows of a scan that sidecars are to be written of: fresh ones without an error, so that failures are tried again."""
    rows = scanned.join(sidecars.select("page_key"), "page_key", "left_anti")
    return rows.where("engine_error IS NULL") if "engine_error" in rows.columns else rows


VERSIONS = ("v1", "v2")


def classifier_version(given: str | None = None, environment: str | None = None) -> str:
    """The classifier's version: the given one, else the environment's, else v1; an unknown one is an error."""
    version = given or environment or VERSIONS[0]
    if version not in VERSIONS:
        raise ValueError(f"the classifier's version must be one of {VERSIONS}, not {version!r}")
    return version


def classify(signals: DataFrame, version: str, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """``signals`` (``dark_ratio, strong_rows, boxes, box_coverage``) with the ``route`` by either version.

    v1 goes by ink alone, and takes a page without readable pixels as text; v2 by
    boxes, with v1 where there are none.
    """
    ink = F.when(F.col("dark_ratio").isNull() | F.col("strong_rows").isNull(), "text").otherwise(classify_pixels(F.col("dark_ratio"), F.col("strong_rows")))
    if classifier_version(version) == "v1":
        return signals.withColumn("route", ink)
    return signals.withColumn("route", classify_boxes(F.col("boxes"), F.col("box_coverage"), F.col("dark_ratio"), policy, ink)["route"])
