r"""Spelling variants: words at one edit from each other, and the commonest spelling of each.

Words are counted in the tasks that read the texts.  The vocabulary is cut into
sorted shards of bounded size, each a compact trie (a branch that leads to one
word only is a leaf).  The tries are broadcast one after the other, and the
distance-one Levenshtein automaton of every word is intersected with each of
them, depth-first: at each node of its exact path a word tries all deletions,
insertions and replacements to their ends before it goes deeper, a block of
words at a time.  Counts and best forms of the shards are reduced by word.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._scratch import materialise
from ._text import LOWER, flat, slices, sliced_sizes, span_hashes

LEAST_CHARS, LEAST_COUNT = 5, 3
#: A word's form is at least so many times as common.
RATIO = 2
#: Bytes of texts whose words are counted at a time; longer texts are cut between words.
COUNT_BYTES = 4 << 20
#: Letters of a trie's words, about: some 35 MB once it is built.
SHARD_LETTERS = 4_000_000
#: Words that go through a trie side by side, and words to a task, about.
BLOCK, TASK_WORDS = 8_192, 65_536
#: Longer runs are hashed one by one.
LONG_RUN = 64

_LOWER = np.frombuffer(LOWER, np.uint8)
#: The first byte of U+00C0 to U+00FF in UTF-8.
_LEAD = 0xC3
_FIRST = np.zeros(256, bool)
_FIRST[[*range(97, 123), _LEAD]] = True
_BREAK = re.compile(rb"[^a-zA-Z\x80-\xFF]")


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()


def _runs(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and text of each run of letters in lower-cased bytes."""
    inside = _FIRST[raw]
    inside[1:] |= raw[:-1] == _LEAD
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    heads = starts[:-1][starts[:-1] < len(raw)]
    begins[heads] = inside[heads]
    tails = starts[1:][starts[1:] > 0] - 1
    stops[tails] = inside[tails]
    first = np.flatnonzero(begins)
    return first, np.flatnonzero(stops) + 1, np.searchsorted(starts, first, side="right") - 1


def _crcs(raw: np.ndarray, first: np.ndarray, last: np.ndarray, begun: np.ndarray) -> np.ndarray:
    """The crc32 of each span, going on from that of the text before it."""
    state = begun ^ np.uint32(0xFFFFFFFF)
    which = np.flatnonzero(last - first <= LONG_RUN)
    at, ends = first[which], last[which]
    while len(which):
        c = state[which]
        state[which] = _CRC[(c ^ raw[at]) & np.uint32(255)] ^ (c >> np.uint32(8))
        at = at + 1
        more = at < ends
        which, at, ends = which[more], at[more], ends[more]
    out = state ^ np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(last - first > LONG_RUN).tolist():
        out[i] = zlib.crc32(raw[first[i] : last[i]].tobytes(), int(begun[i]))
    return out


def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether ``a`` and ``b`` have the same ``size`` bytes from ``at`` and ``bt`` on."""
    out = np.ones(len(size), bool)
    which = np.flatnonzero(size > 0)
    k = 0
    while len(which):
        same = a[at[which] + k] == b[bt[which] + k]
        out[which[~same]] = False
        k += 1
        which = which[same & (size[which] > k)]
    return out


def _strings(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    """The spans as an Arrow array of strings."""
    ends = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=ends[1:])
    bytes_at = np.arange(ends[-1]) + np.repeat(first - ends[:-1], size)
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(ends), pa.py_buffer(raw[bytes_at])).cast(pa.string())


def _tally(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The different spans, and how often each is found."""
    keys = span_hashes(raw, first, last)
    _, at, group, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    size = last - first
    if not ((size == size[at][group]).all() and _equal(raw, first, raw, first[at][group], size).all()):  # a hash for two words
        counted = Counter(raw[a:b].tobytes() for a, b in zip(first.tolist(), last.tolist(), strict=True))
        return pa.array([w.decode() for w in counted], pa.string()), np.array(list(counted.values()), np.int64)
    return _strings(raw, first[at], size[at]), n


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size; texts beyond it are cut between runs."""
    for batch in slices(batches, "text", COUNT_BYTES):
        if batch.num_rows > 1 or not batch.num_rows or sliced_sizes(batch.column("text"))[0] <= COUNT_BYTES:
            yield batch
            continue
        text, at = batch.column("text").cast(pa.large_binary())[0].as_py(), 0
        while at < len(text):
            cut = _BREAK.search(text, at + COUNT_BYTES)
            stop = cut.end() if cut else len(text)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array([text[at:stop]], pa.large_binary())], names=["_id", "text"])
            at = stop


def _count(batches: Iterator[pa.RecordBatch], least: int, typo_every: int | None) -> Iterator[pa.RecordBatch]:
    for batch in _pieces(batches):
        raw, starts = flat(batch.column("text"))
        raw = _LOWER[raw]
        first, last, doc = _runs(raw, starts)
        leads = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(raw == _LEAD, out=leads[1:])
        size = last - first - (leads[last] - leads[first])
        full = size >= least  # a deletion makes no word longer
        first, last, doc, size = first[full], last[full], doc[full], size[full]
        typos: Counter[str] = Counter()
        if typo_every and len(first):
            ids = batch.column("_id").to_pylist()
            begun = np.array([zlib.crc32(f"{x}:".encode()) for x in ids], np.uint32)
            crc = _crcs(raw, first, last, begun[doc])
            hit = crc % np.uint32(typo_every) == 0
            for a, b, k in zip(first[hit].tolist(), last[hit].tolist(), (crc[hit] % size[hit]).tolist(), strict=True):
                word = raw[a:b].tobytes().decode()
                if len(word) > least:
                    typos[word[:k] + word[k + 1 :]] += 1
            first, last = first[~hit], last[~hit]
        if len(first):
            words, n = _tally(raw, first, last)
            yield pa.RecordBatch.from_arrays([words, pa.array(n, pa.int64())], names=["word", "n"])
        if typos:
            yield pa.RecordBatch.from_arrays([pa.array(typos.keys(), pa.string()), pa.array(typos.values(), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, typo_every: int | None = None) -> DataFrame:
    """``word, n``: the words of ``docs`` (``doc_id``, ``text``) with at least ``least_count`` occurrences."""
    narrow = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), "text")
    counts = narrow.mapInArrow(lambda b: _count(b, least_chars, typo_every), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters of words as numbers in code-point order (a-z, then U+00C0 to U+00FF), and where each word starts."""
    raw, starts = flat(column)
    keep = raw != _LEAD
    before = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    kept = raw[keep]
    return np.where(kept < 128, kept - 97, kept - 128 + 26).astype(np.uint8), before[starts]


class CompactTrie:
    """Of sorted, different words; nodes are numbered breadth-first, so that children stand together in order of their letters."""

    def __init__(self, s: np.ndarray, at: np.ndarray, n: np.ndarray):
        self.s, self.at, self.n, self.size = s, at[:-1], n, np.diff(at)
        kinds = np.uint64(1) << np.minimum(self.size, 63).astype(np.uint64)
        #: By level: letters of nodes, the word a node is the last letter of, the word of a leaf, word lengths below, first child, children.
        label, term, leaf, lens, first, kids = [np.zeros(1, np.uint8)], [], [np.full(1, -1)], [np.bitwise_or.reduce(kinds, keepdims=True)], [], []
        words, group, depth, total, nodes = np.arange(len(n)), np.zeros(len(n), np.int64), 0, 1, 1
        while nodes:
            here = np.full(nodes, -1)
            ends = self.size[words] == depth
            here[group[ends]] = words[ends]
            words, group = words[~ends], group[~ends]
            letter = s[self.at[words] + depth]
            new = np.ones(len(words), bool)
            new[1:] = (group[1:] != group[:-1]) | (letter[1:] != letter[:-1])
            head = np.flatnonzero(new)
            held = np.diff(head, append=len(words))
            n_kids = np.bincount(group[head], minlength=nodes)
            term.append(here)
            kids.append(n_kids)
            first.append(total + np.cumsum(n_kids) - n_kids)
            alone = held == 1
            label.append(letter[head])
            leaf.append(np.where(alone, words[head], -1))
            lens.append(np.bitwise_or.reduceat(kinds[words], head) if len(head) else kinds[:0])
            child = np.cumsum(new) - 1
            stay = ~alone[child] if len(head) else np.zeros(0, bool)
            words, group, nodes, depth = words[stay], child[stay], len(head), depth + 1
            total += nodes
        self.label, self.leaf, self.lens = np.concatenate(label), np.concatenate(leaf).astype(np.int32), np.concatenate(lens)
        self.term, self.first, self.kids = (np.concatenate(x).astype(np.int32) for x in (term, first, kids))
        #: Which letters go on from a node, in two words of 64 bits, and the child before the first one of each.
        parent = np.repeat(np.arange(total), self.kids)
        self.masks = np.zeros(2 * total, np.uint64)
        child_letter = self.label[1:]
        np.bitwise_or.at(self.masks, 2 * parent + (child_letter >> 6), np.uint64(1) << (child_letter & 63).astype(np.uint64))
        self.base = np.repeat(self.first, 2)
        self.base[1::2] += np.bitwise_count(self.masks[::2]).astype(np.int32)

    @classmethod
    def load(cls, arrays: bytes) -> CompactTrie:
        trie = cls.__new__(cls)
        vars(trie).update(pickle.loads(arrays))
        return trie

    def step(self, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which nodes have a child with that letter, and these children."""
        k = 2 * node + (letter >> 6)
        bit = np.uint64(1) << (letter & 63).astype(np.uint64)
        mask = self.masks[k]
        there = np.flatnonzero(mask & bit)
        return there, self.base[k[there]] + np.bitwise_count(mask[there] & (bit[there] - np.uint64(1)))

    def _ends(self, q, node, s, at, size, pos: int, delta: int, out: list) -> None:
        """Words of the trie that go on from ``node`` as the words ``q`` do from ``pos``; they are ``delta`` letters longer."""
        while len(q):
            may = np.flatnonzero(self.lens[node] >> np.minimum(size[q] + delta, 63).astype(np.uint64) & np.uint64(1))
            q, node = q[may], node[may]
            leaf = self.leaf[node]
            ends = np.flatnonzero(leaf >= 0)
            if len(ends):
                a, j = q[ends], leaf[ends]
                fits = self.size[j] == size[a] + delta
                a, j = a[fits], j[fits]
                same = _equal(s, at[a] + pos, self.s, self.at[j] + pos + delta, size[a] - pos)
                out.append((a[same], j[same]))
                go = np.flatnonzero(leaf < 0)
                q, node = q[go], node[go]
            over = size[q] == pos
            if over.any():
                a, j = q[over], self.term[node[over]]
                out.append((a[j >= 0], j[j >= 0]))
                q, node = q[~over], node[~over]
            there, node = self.step(node, s[at[q] + pos])
            q, pos = q[there], pos + 1

    def _leaves(self, q, j, s, at, size, pos: int, out: list) -> None:
        """Of words that lead to a leaf, with ``pos`` letters in common: those at one edit from its word."""
        delta = self.size[j] - size[q]
        fits = np.abs(delta) <= 1
        q, j, delta = q[fits], j[fits], delta[fits]
        shared = np.full(len(q), pos)
        which = np.arange(len(q))
        while len(which):
            k = shared[which]
            which = which[(k < size[q[which]]) & (k < self.size[j[which]])]
            k = shared[which]
            which = which[s[at[q[which]] + k] == self.s[self.at[j[which]] + k]]
            shared[which] += 1
        a, b = shared + (delta <= 0), shared + (delta >= 0)
        left = size[q] - a
        same = (left >= 0) & _equal(s, at[q] + a, self.s, self.at[j] + b, left)
        out.append((q[same], j[same]))

    def near(self, s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a given word and a word of the trie at one edit from it, each pair once, in order."""
        size, at = np.diff(at), at[:-1]
        q, node, i = np.arange(len(size)), np.zeros(len(size), np.int64), 0
        out = [(q[:0], q[:0])]
        while len(q):
            goes = np.flatnonzero(size[q] > i)
            self._ends(q[goes], node[goes], s, at, size, i + 1, -1, out)
            kids = self.kids[node]
            many = np.repeat(q, kids)
            child = np.arange(len(many)) + np.repeat(self.first[node] - (np.cumsum(kids) - kids), kids)
            self._ends(many, child, s, at, size, i, 1, out)
            goes = np.flatnonzero(size[many] > i)
            goes = goes[s[at[many[goes]] + i] != self.label[child[goes]]]
            self._ends(many[goes], child[goes], s, at, size, i + 1, 0, out)
            longer = np.flatnonzero(size[q] > i)
            q, node = q[longer], node[longer]
            there, node = self.step(node, s[at[q] + i])
            q, i = q[there], i + 1
            leaf = self.leaf[node]
            if (leaf >= 0).any():
                self._leaves(q[leaf >= 0], leaf[leaf >= 0], s, at, size, i, out)
                q, node = q[leaf < 0], node[leaf < 0]
        pairs = np.unique(np.concatenate([a * len(self.n) + j for a, j in out]))
        return pairs // len(self.n), pairs % len(self.n)


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The tries of a sorted partition, a row each."""
    held, size = [], 0

    def row():
        table = pa.Table.from_batches(held).combine_chunks()
        trie = CompactTrie(*letters(table["word"].chunk(0)), table["n"].to_numpy())
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(trie))], pa.binary())], names=["trie"])

    for batch in batches:
        ends = np.cumsum(sliced_sizes(batch.column("word")))
        start = 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + (not held), int(np.searchsorted(ends, before + SHARD_LETTERS - size, side="right")))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                size += int(ends[stop - 1]) - before
            if stop < batch.num_rows:
                yield row()
                held, size = [], 0
            start = stop
    if held:
        yield row()


_FOUND = "word string, n_near long, best_n long, best string"


def _match(batches: Iterator[pa.RecordBatch], trie) -> Iterator[pa.RecordBatch]:
    """For each word that has near words in a trie: how many, and the commonest (the first of these in order)."""
    shard = CompactTrie.load(trie.value)
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            words = batch.column("word").slice(start, BLOCK)
            q, j = shard.near(*letters(words))
            order = np.lexsort((j, -shard.n[j], q))
            q, j = q[order], j[order]
            head = np.flatnonzero(np.diff(q, prepend=-1))
            best = j[head]
            raw = shard.s[np.arange(shard.size[best].sum()) + np.repeat(shard.at[best] - (np.cumsum(shard.size[best]) - shard.size[best]), shard.size[best])]
            spelled = np.where(raw < 26, raw + 97, raw + (0xC0 - 26)).astype(np.uint8).tobytes().decode("latin-1")
            ends = np.cumsum(shard.size[best])
            forms = [spelled[a:b] for a, b in zip((ends - shard.size[best]).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [words.take(pa.array(q[head])), pa.array(np.diff(head, append=len(q)), pa.int64()), pa.array(shard.n[best], pa.int64()), pa.array(forms, pa.string())],
                names=["word", "n_near", "best_n", "best"],
            )


def _near(words: DataFrame) -> list[DataFrame]:
    """What each trie tells about the words."""
    spark = words.sparkSession
    # sorted again: a task may read several files, in any order
    tries = materialise(words.sortWithinPartitions("word").mapInArrow(_tries, "trie binary"), "tries")
    found = []
    for row in tries.toLocalIterator():  # one trie at a time
        trie = spark.sparkContext.broadcast(bytes(row["trie"]))
        found.append(materialise(words.mapInArrow(lambda b, t=trie: _match(b, t), _FOUND), "near-words"))
        trie.destroy()
    return found


def _roots(links: DataFrame) -> DataFrame:
    """``word, root`` for ``word, form``: forms followed to the last one, by doubling.

    Counts double at least from word to form, so that 63 steps are never reached
    and six rounds always do.
    """
    ends = links.select("word", F.col("form").alias("root"))
    while True:
        then = ends.select(F.col("word").alias("root"), F.col("root").alias("_then"))
        ends = materialise(ends.join(then, "root", "left").select("word", F.coalesce("_then", "root").alias("root"), F.col("_then").isNotNull().alias("_moved")), "roots")
        if ends.where("_moved").isEmpty():
            return ends.select("word", "root")
        ends = ends.select("word", "root")


def spelling_variants(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO, typo_every: int | None = None) -> DataFrame:
    r"""``word, form, root, n, n_near, form_n`` for each word of ``docs`` (``doc_id``, ``text``).

    Words are maximal runs ``[A-Za-zÀ-ÿ]+`` with A-Z in lower case, of at
    least ``least_chars`` code points and ``least_count`` occurrences (``n``) over all
    texts.  ``n_near`` counts the words at one inserted, deleted or replaced code
    point; ``form`` is the commonest of them (ties: the first in code-point order)
    if it is ``ratio`` times as common as the word or more, ``form_n`` its count;
    ``root`` is where forms lead to in the end, the word itself if it has none.

    ``typo_every``: in a text whose ``<doc_id>:<run>`` has a crc32 divisible by it, a
    run loses the code point at crc32 modulo its length, as if mistyped.

    Null and empty texts have no words.  A null id is written as nothing.  Rows
    that repeat are counted each; other columns are not read.  A text beyond
    ``COUNT_BYTES`` is counted in pieces cut between words, a run of any length is one
    word.  An empty table, or one without words, gives an empty table.
    """
    if ratio < 2:
        raise ValueError("forms must be at least twice as common, or following them might not end")
    counted = materialise(vocabulary(docs, least_chars, least_count, typo_every), "vocabulary")
    size = counted.agg(F.count("*"), F.sum(F.length("word"))).first()
    parts = max(1, -(-size[0] // TASK_WORDS), -(-(size[1] or 0) // (SHARD_LETTERS // 2)))
    words = materialise(counted.repartitionByRange(parts, "word"), "words")
    known = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<_less:bigint,best:string>").alias("_best"))
    near = [x.select("word", F.lit(None).cast("long").alias("n"), "n_near", F.struct((-F.col("best_n")).alias("_less"), "best").alias("_best")) for x in _near(words)]
    whole = reduce(DataFrame.unionAll, near, known).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("_best").alias("_best"))
    has = -F.col("_best._less") >= ratio * F.col("n")
    forms = materialise(whole.select("word", "n", "n_near", F.when(has, F.col("_best.best")).alias("form"), F.when(has, -F.col("_best._less")).alias("form_n")), "forms")
    roots = _roots(forms.where("form IS NOT NULL").select("word", "form"))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"), typo_every=97)


SQL = """
WITH RECURSIVE
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{C0}-\\x{FF}]+')) AS run FROM documents)
  GROUP BY doc_id, run HAVING length(run) >= 5),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(
           list_concat([4294967295], flatten(list_transform(
             flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)),
             lambda b: [CAST(b AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) AS h
  FROM runs),
typed AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, left(word, CAST(i AS INTEGER)) || substr(word, CAST(i AS INTEGER) + 2) AS rest FROM words, UNNEST(range(length(word))) AS u(i)),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, encode(near)) AS form, max(n) AS form_n FROM pairs GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form, CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
chains AS (
  SELECT word, word AS root, form AS onward FROM forms
  UNION ALL SELECT c.word, f.word, f.form FROM chains c JOIN forms f ON f.word = c.onward)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chains c ON c.word = f.word WHERE c.onward IS NULL
"""
