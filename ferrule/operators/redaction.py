"""Reversible redaction: entities become placeholders that are stable over the corpus."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrule.sources.scratch import materialise

#: Runs of capitalised words, runs of digits, and what a placeholder looks like.
PROPER_NOUN = r"[A-Z][A-Za-z0-9'’]*(?:(?:\.?[ \t]+|[ \t]*&[ \t]*|-)[A-Z][A-Za-z0-9'’]*)*"
DIGITS = r"\d+(?:[,.\- ]\d+)*"
PLACEHOLDER = r"<[A-Z][A-Z0-9_]*_\d+>"
#: Literals to an automaton: some 100 MB in a worker.
MOST_LITERALS = 200_000
#: Spans that leave a task at a time, about.
ROWS = 20_000
#: Texts that are redacted at a time.
TEXTS = 256
_TYPE = re.compile("[A-Z][A-Z0-9_]*")
_SPANS = "array<struct<start:int,stop:int,type:string>>"


@dataclass(frozen=True)
class Dictionary:
    entities: dict[str, tuple[str, ...]] = field(default_factory=dict)
    patterns: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not any((*self.entities.values(), *self.patterns.values())):
            raise ValueError("the dictionary is empty")
        for kind in (*self.entities, *self.patterns):
            if not _TYPE.fullmatch(kind):
                raise ValueError(f"{kind!r} is no entity type")
        for kind, patterns in self.patterns.items():
            for i, p in enumerate(patterns):
                try:
                    re.compile(p)
                except re.error:
                    raise ValueError(f"pattern {i} of {kind} does not compile") from None  # the pattern itself may be secret

    def of(self, literals: list[tuple[str, str]], patterns: bool) -> Dictionary:
        """With these literals alone, and the patterns or none."""
        kinds: dict[str, list[str]] = {}
        for kind, x in literals:
            kinds.setdefault(kind, []).append(x)
        return Dictionary({k: tuple(v) for k, v in kinds.items()}, self.patterns if patterns else {})

    def literals(self) -> list[tuple[str, str]]:
        return [(kind, x) for kind, xs in self.entities.items() for x in xs]

    def rules(self, strict: bool) -> list[tuple[str, str]]:
        out = [(kind, p) for kind, ps in self.patterns.items() for p in ps]
        return [*out, ("PN", PROPER_NOUN), ("NUM", DIGITS)] if strict else out


def load_dictionary(path: str) -> Dictionary:
    from pathlib import Path

    import yaml

    raw = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(raw, dict):
        raise ValueError("the dictionary is no mapping")
    each = lambda part: {k: tuple(v or ()) for k, v in (raw.get(part) or {}).items()}
    return Dictionary(each("entities"), each("patterns"))


def _literals(found: ahocorasick.Automaton | None, text: str) -> list[tuple[int, int, str]]:
    """All literals of an automaton in a text; those of one literal do not overlap."""
    out, last = [], {}
    for end, (size, kinds) in found.iter(text) if found else ():
        start = end + 1 - size
        if start >= last.get(text[start : end + 1], 0):
            last[text[start : end + 1]] = end + 1
            out += [(start, end + 1, kind) for kind in kinds]
    return out


def resolved(spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that do not overlap, in order: longer ones first, then earlier ones, then by type; each run of spans that overlap is settled by itself."""
    out, run, end = [], [], 0
    for s in sorted(spans):
        if run and s[0] >= end:
            out += run if len(run) == 1 else _settle(run)
            run = []
        run.append(s)
        end = max(end, s[1])
    return out + (run if len(run) == 1 else _settle(run))


def _settle(run: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """What is kept stands sorted, so that a span meets its two neighbours only."""
    starts: list[int] = []
    kept: list[tuple[int, int, str]] = []
    for s in sorted(run, key=lambda s: (s[0] - s[1], s[0], s[2])):
        i = bisect_left(starts, s[0])
        if (i == 0 or kept[i - 1][1] <= s[0]) and (i == len(kept) or s[1] <= kept[i][0]):
            starts.insert(i, s[0])
            kept.insert(i, s)
    return kept


def _automaton(literals: list[tuple[str, str]]) -> ahocorasick.Automaton | None:
    kinds: dict[str, list[str]] = {}
    for kind, x in literals:
        if x:
            kinds.setdefault(x, []).append(kind)
    if not kinds:
        return None
    out = ahocorasick.Automaton()
    for x, ks in kinds.items():
        out.add_word(x, (len(x), tuple(ks)))
    out.make_automaton()
    return out


def _finder(literals: list[tuple[str, str]], rules: list[tuple[str, str]]) -> Callable[[str | None], list[tuple[int, int, str]]]:
    """All matches in a text with their offsets: literals by one automaton, patterns by regular expressions."""
    automaton, compiled = _automaton(literals), [(kind, re.compile(p)) for kind, p in rules]

    def find(text: str | None) -> list[tuple[int, int, str]]:
        text = text or ""
        found = [(m.start(), m.end(), kind) for kind, p in compiled for m in p.finditer(text) if m.end() > m.start()]
        return [s for s in found if s[2] != "NUM" or sum(map(str.isdigit, text[s[0] : s[1]])) >= 2] + _literals(automaton, text)

    return find


def _found(docs: DataFrame, dictionary: Dictionary, strict: bool, settle: bool) -> DataFrame:
    """``doc_id, pos, start, stop, type, entity`` of ``docs`` (``doc_id, text``): all matches, or those that are left when overlaps are settled.

    Arrow batches, as SQL's regular expressions do not tell offsets; rows leave a
    task in batches of some ``ROWS``, and no text goes with them.
    """
    sent, rules = docs.sparkSession.sparkContext.broadcast(dictionary.literals()), dictionary.rules(strict)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(sent.value, rules)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "pos", "start", "stop", "type", "entity"])

        for incoming in batches:
            types, rows = [incoming.schema.field("doc_id").type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()], []
            for i in range(incoming.num_rows):
                doc, text = incoming.column("doc_id")[i].as_py(), incoming.column("text")[i].as_py()
                spans = find(text)
                rows += [(doc, n, *s, text[s[0] : s[1]]) for n, s in enumerate(resolved(spans) if settle else spans)]
                if len(rows) >= ROWS:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, pos int, start int, stop int, type string, entity string")


def _settled(spans: pd.Series) -> pd.Series:
    return pd.Series([[{"start": a, "stop": b, "type": k} for a, b, k in resolved([(s["start"], s["stop"], s["type"]) for s in row])] for row in spans])


def numbered(rows: DataFrame, group: str, order: list[str], name: str = "idx") -> DataFrame:
    """Number rows from 1 within each group, without gathering a group in one task.

    Rows are dealt by ranges of group and order; each range's counts, one row a
    range and group, give the offset of the next.
    """
    # stored: the bounds of ranges are sampled, and both uses below must see the same ones
    dealt = materialise(rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(group, "_part", before.alias("_before"))
    local = F.row_number().over(Window.partitionBy("_part", group).orderBy(*order))
    return dealt.withColumn("_local", local).join(offsets, [group, "_part"]).withColumn(name, (F.col("_before") + F.col("_local")).cast("int")).drop("_part", "_local", "_before")


def entities(docs: DataFrame, dictionary: Dictionary, strict: bool = False) -> DataFrame:
    """``doc_id, pos, start, stop, type, entity``: one row a span that is replaced.

    At most ``MOST_LITERALS`` literals make up an automaton.  A larger dictionary goes over
    the texts in several passes, each stored, whose spans are settled together.
    """
    narrow, literals = docs.select("doc_id", "text"), dictionary.literals()
    if len(literals) <= MOST_LITERALS:
        return _found(narrow, dictionary, strict, settle=True)
    blocks = [literals[i : i + MOST_LITERALS] for i in range(0, len(literals), MOST_LITERALS)]
    passes = [materialise(_found(narrow, dictionary.of(block, i == 0), strict and i == 0, settle=False), "spans") for i, block in enumerate(blocks)]
    spans = reduce(DataFrame.unionAll, passes).groupBy("doc_id").agg(F.collect_list(F.struct("start", "stop", "type")).alias("_all"))
    rows = narrow.join(spans.select("doc_id", F.pandas_udf(_settled, _SPANS)("_all").alias("_spans")), "doc_id").select("doc_id", "text", F.posexplode("_spans").alias("pos", "s"))
    entity = F.substr("text", F.col("s.start") + 1, F.col("s.stop") - F.col("s.start"))
    return rows.select("doc_id", "pos", "s.start", "s.stop", F.col("s.type").alias("type"), entity.alias("entity"))


def mapping(spans: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``entity_type, entity_text, idx``: the known entities and the new ones, numbered on in order of first sight."""
    first = spans.groupBy(F.col("type").alias("entity_type"), F.col("entity").alias("entity_text")).agg(F.min(F.struct("doc_id", "start")).alias("seen"))
    if known is not None:
        first = first.join(known, ["entity_type", "entity_text"], "left_anti")
    fresh = numbered(first.select("entity_type", "entity_text", F.col("seen.doc_id").alias("_doc"), F.col("seen.start").alias("_start")), "entity_type", ["_doc", "_start"])
    if known is None:
        return fresh.select("entity_type", "entity_text", "idx")
    top = F.broadcast(known.groupBy("entity_type").agg(F.max("idx").alias("_top")))
    moved = fresh.join(top, "entity_type", "left").select("entity_type", "entity_text", (F.col("idx") + F.coalesce("_top", F.lit(0))).alias("idx"))
    return known.select("entity_type", "entity_text", "idx").unionByName(moved)


def placeholder(type_: Column, idx: Column) -> Column:
    return F.concat(F.lit("<"), type_, F.lit("_"), idx.cast("string"), F.lit(">"))


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, redacted_text, spans_replaced`` of texts with their tokens ``_t`` in order; a text is passed over once, which SQL's substrings would do for each token."""
    for whole in batches:
        for first in range(0, whole.num_rows, TEXTS):
            batch = whole.slice(first, TEXTS)
            listed, out = batch.column("_t"), []
            ends = np.cumsum(pc.fill_null(listed.value_lengths(), 0).to_numpy()).tolist()
            start, stop, token = (listed.flatten().field(c).to_pylist() for c in ("start", "stop", "token"))
            for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
                text = batch.column("text")[i].as_py()
                if b > a:
                    gaps = (text[x:y] for x, y in zip([0, *stop[a:b]], [*start[a:b], None], strict=True))
                    text = "".join(x for both in zip(gaps, [*token[a:b], ""], strict=True) for x in both)
                out.append(text)
            n = pa.array(np.diff(ends, prepend=0), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string()), n], names=["doc_id", "redacted_text", "spans_replaced"])


def redact(docs: DataFrame, spans: DataFrame, mapping_: DataFrame) -> DataFrame:
    """``doc_id, redacted_text, spans_replaced`` of ``docs`` (``doc_id, text``).

    A text that holds a placeholder of ``mapping_`` already could not be restored:
    there the redaction is refused, before any of it is done.
    """
    held = irreversible(docs, mapping_).orderBy("doc_id", "token").first()
    if held:
        raise ValueError(f"text {held['doc_id']} already holds the placeholder {held['token']}: its redaction could not be undone")
    tokens = spans.join(mapping_, (spans["type"] == mapping_["entity_type"]) & (spans["entity"] == mapping_["entity_text"]))
    tokens = tokens.select("doc_id", "start", "stop", placeholder(F.col("type"), F.col("idx")).alias("token"))
    per_doc = tokens.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop", "token"))).alias("_t"))
    joined = docs.select("doc_id", "text").join(per_doc, "doc_id", "left")
    return joined.mapInArrow(_replaced, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, redacted_text string, spans_replaced int")


def irreversible(docs: DataFrame, mapping_: DataFrame) -> DataFrame:
    """``doc_id, token``: texts that hold an issued placeholder already and so could not be restored."""
    held = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(PLACEHOLDER), F.lit(0)))).alias("token"))
    return held.join(mapping_.select(placeholder(F.col("entity_type"), F.col("idx")).alias("token")), "token", "left_semi")


def restore(docs: DataFrame, mapping_: DataFrame, column: str = "redacted_text") -> DataFrame:
    """``doc_id, text``: known placeholders replaced by what they stand for; unknown ones stay."""
    # stored: both uses below would redact the texts anew
    rows = materialise(docs.select("doc_id", F.col(column).alias("_r")), "redacted")
    held = rows.select("doc_id", F.posexplode(F.regexp_extract_all("_r", F.lit(PLACEHOLDER), F.lit(0))).alias("i", "token"))
    known = mapping_.select(placeholder(F.col("entity_type"), F.col("idx")).alias("token"), "entity_text")
    found = held.join(known, "token", "left").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("entity_text", "token").alias("v"))))["v"].alias("_v"))
    gaps = F.split("_r", PLACEHOLDER, -1)
    text = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.try_element_at("_v", i + 1), F.lit("")))), "")
    return rows.join(found, "doc_id", "left").select("doc_id", F.when(F.col("_v").isNull(), F.col("_r")).otherwise(text).alias("text"))
