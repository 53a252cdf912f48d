"""Benchmark decontamination with a generalised suffix automaton.

The automaton is over words, of all benchmark items (in blocks of bounded
size).  Document words stream through it; a state's longest match tells which
words lie inside an item's window.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import LOWER, alnum_words, slices, texts_of

WINDOW = 13
#: A document with at least one hit word in so many words is contaminated.
COVERAGE = 20
#: Words of items to one automaton.  A larger benchmark is matched in several blocks.
BLOCK_WORDS = 100_000


class SuffixAutomaton:
    """Of several word sequences; each state knows the items in which its words end.

    ``window`` and shorter whole items are what counts: ``items_at`` and
    ``reach`` are kept for the states a window or a short item ends in.
    """

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.shortest = window
        coded = []
        for item, words in items:
            if words:
                codes = [self.words.setdefault(w, len(self.words)) for w in words]
                coded.append((item, codes))
                self.shortest = min(self.shortest, len(codes))
                last = 0
                for c in codes:
                    last = self._extend(last, c)
        self._mark(coded)

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            return q if length[q] == length[last] + 1 else self._clone(last, c, q)
        state = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = state
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            link[state] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return state

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def _mark(self, coded: list[tuple[str | None, list[int]]]) -> None:
        n, w = len(self.next), self.window
        #: For each state: the items one of whose windows ends here, with the window's length.
        self.own: dict[int, list[tuple[str | None, int]]] = {}
        for item, codes in coded:
            state = depth = 0
            marked = set()
            size = min(w, len(codes))
            for c in codes:
                # the longest suffix of what is read, no longer than the window
                state = self.next[state][c]
                depth += 1
                while self.length[self.link[state]] >= size:
                    state = self.link[state]
                depth = min(depth, size, self.length[state])
                if depth == size and state not in marked:
                    marked.add(state)
                    self.own.setdefault(state, []).append((item, size))
        #: For each state: the longest window that may end here or at a shorter suffix.
        self.near = [-1] * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            self.near[s] = s if s in self.own else self.near[self.link[s]]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Spans of words inside windows of items (in order, they may overlap), and the items."""
        get = self.words.get
        codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = np.flatnonzero(np.diff(np.concatenate([[0], codes >= 0, [0]]).astype(np.int8)))
        runs = known.reshape(-1, 2)
        runs = runs[runs[:, 1] - runs[:, 0] >= self.shortest]
        spans: list[tuple[int, int]] = []
        found: set[str | None] = set()
        for start, stop in runs.tolist():
            self._match(codes[start:stop].tolist(), start, spans, found)
        return spans, found

    def _match(self, codes: list[int], start: int, spans: list, found: set) -> None:
        """As ``scan``, of words that the items all have."""
        nxt, link, length, near, own = self.next, self.link, self.length, self.near, self.own
        state = depth = 0
        for i, c in enumerate(codes, start + 1):
            while c not in nxt[state] and state:
                state = link[state]
                depth = length[state]
            if c in nxt[state]:
                state = nxt[state][c]
                depth += 1
            s, longest = near[state], 0
            while s > 0:
                for item, size in own[s]:
                    if size <= depth:
                        longest = max(longest, size)
                        found.add(item)
                s = near[link[s]]
            if longest:
                spans.append((i - longest, i))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, as spans apart from each other, in order."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def _scan(batches: Iterator[pa.RecordBatch], automaton) -> Iterator[pa.RecordBatch]:
    """Add the spans and items of one block to those of the blocks before it."""
    matcher = automaton.value
    for batch in slices(batches, "text"):
        n_words, all_spans, all_items = [], [], []
        for text, spans, items in zip(texts_of(batch.column("text")), batch.column("_spans").to_pylist(), batch.column("items").to_pylist(), strict=True):
            words = alnum_words(text)
            more, found = matcher.scan(words)
            n_words.append(len(words))
            if more:
                spans = [x for pair in merged([*zip(spans[::2], spans[1::2], strict=True), *more]) for x in pair]
                items = sorted({*items, *(x for x in found if x is not None)})
            all_spans.append(spans)
            all_items.append(items)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(all_spans, pa.list_(pa.int64())), pa.array(all_items, pa.list_(pa.string()))],
            names=["doc_id", "text", "n_words", "_spans", "items"],
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = [sum(s[1::2]) - sum(s[::2]) for s in batch.column("_spans").to_pylist()]
        items = batch.column("items").to_pylist()
        words = batch.column("n_words").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("n_words"),
                pa.array(hits, pa.int64()),
                pa.array([len(x) for x in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                pa.array([h > 0 and COVERAGE * h >= n for h, n in zip(hits, words, strict=True)], pa.bool_()),
                batch.column("items"),
                batch.column("_spans"),
            ],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"],
        )


def _blocks(items: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for row in items.select(F.col("item_id").cast("string").alias("item_id"), "text").toLocalIterator():
        words = alnum_words((row["text"] or "").encode())
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((row["item_id"], words))
        size += len(words)
    yield block


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans`` for each row of ``docs``.

    A window is ``window`` consecutive words of an item, or the whole of a
    shorter item.  ``spans`` are the words inside windows, as start, stop, start,
    stop ...; ``contaminated``: there are some, and they make up at least one word
    in ``COVERAGE``.

    Null and empty texts have no words, of documents or items; such items match
    nothing.  Items without an id hit but are not listed; items that repeat an id
    are listed once.  Repeated rows and null ids of documents pass through, row
    by row; other columns are not read.  Without items nothing is hit; an empty
    table of documents gives an empty table.  A text's words are matched one
    after the other, and held in one piece, whatever their number.

    The automaton of at most ``block_words`` words (some 60 MB at the default; one
    longer item is a block of its own) is sent to each executor, block by block.
    """
    spark = docs.sparkSession
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("_spans"), F.array().cast("array<string>").alias("items"))
    for block in _blocks(items, block_words):
        automaton = spark.sparkContext.broadcast(SuffixAutomaton(block, window))
        out = out.mapInArrow(lambda b, a=automaton: _scan(b, a), "doc_id long, text string, n_words long, _spans array<long>, items array<string>")
    return out.drop("text").mapInArrow(_count, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<long>")


def _clean(batches: Iterator[pa.RecordBatch], automata: list) -> Iterator[pa.RecordBatch]:
    matchers = [a.value for a in automata]
    for batch in slices(batches, "text"):
        keep = []
        for text in texts_of(batch.column("text")):
            words = alnum_words(text)
            hit = sum(stop - start for start, stop in merged([s for m in matchers for s in m.scan(words)[0]]))
            keep.append(hit == 0 or COVERAGE * hit < len(words))
        yield batch.filter(pa.array(keep, pa.bool_()))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``decontaminate`` does not call contaminated.

    Rows are judged one by one: nulls, repeats and an empty table as there.
    """
    automata = [docs.sparkSession.sparkContext.broadcast(SuffixAutomaton(block, window)) for block in _blocks(items, block_words)]
    return docs.mapInArrow(lambda b: _clean(b, automata), docs.schema)


def without_spans(text: str, spans: list[int]) -> str:
    """The text less the words in ``spans`` and what stands between them; other characters stay."""
    if not spans:
        return text
    raw = text.encode()
    at = [m.span() for m in re.finditer(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw.translate(LOWER))]
    out, done = [], 0
    for start, stop in zip(spans[::2], spans[1::2], strict=True):
        out.append(raw[done : at[start][0]])
        done = at[stop - 1][1]
    return b"".join([*out, raw[done:]]).decode()


def query(spark, sf_dir: str) -> DataFrame:
    read = spark.read.parquet
    return decontaminate(read(f"{sf_dir}/documents.parquet"), read(f"{sf_dir}/benchmark.parquet")).drop("items", "spans")


SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM documents),
b AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws
  FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS k, array_to_string(list_slice(ws, i, i + least(13, len(ws)) - 1), ' ') AS g
  FROM b, UNNEST(range(1, len(ws) - least(13, len(ws)) + 2)) AS u(i) WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM wins),
grams AS (
  SELECT doc_id, i, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS g
  FROM d, ks, UNNEST(range(1, len(ws) - k + 2)) AS u(i)),
found AS (SELECT doc_id, i, grams.k, item_id FROM grams JOIN wins ON grams.k = wins.k AND grams.g = wins.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, UNNEST(range(i, i + k)) AS u(p) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
