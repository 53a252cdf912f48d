"""Exact substring dedup by bucket-pointer refinement.

A byte goes if a 100-byte string that covers it also starts earlier.  As in a
suffix array built by bucket pointers, positions fall into buckets by their
first q bytes; a bucket is refined by sorting its positions on the identifiers
of the buckets at a later offset, and each pass reuses the identifiers that the
last one gave (``refined``).  Positions alone in their bucket drop out.

Positions that cannot share a bucket are kept apart, so that buckets fit tasks.
Each 100-byte string has among its 24-byte q-grams one with the least
identifier, the first of them its anchor; equal strings have equal anchors.
About one position in 34 is an anchor.

1. Anchors are dealt to tasks by q-gram, with 128 bits of XXH3 of all the bytes
   that strings with this anchor can hold.  If these agree with an earlier
   anchor's, all the anchor's strings go.  Those that agree with an earlier one
   of their own run of documents are settled there and not dealt.
2. Of a q-gram with several such surroundings, one anchor for each is left to
   refine: the bytes of its strings are dealt by q-gram and refined byte by
   byte; the earliest string of a bucket stays.  Strings of very common q-grams
   are dealt one by one, as 128 bits of XXH3.
3. Documents meet what was found in them, and the bytes are cut.

Tasks exchange compressed arrays, one for each bucket and run of documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blobs import bucket_count, press, unpress
from ._scratch import materialise
from ._text import flat, mixed, slices

LENGTH = 100
Q = 24
#: Bytes of texts to a bucket, about.
BUCKET_BYTES = 12 << 20
#: Bytes of texts whose anchors are sent together.
RUN_BYTES = 32 << 20
#: Bytes of an initial bucket's strings.
FIRST = 8
#: Positions that are refined together, about.
PART = 4 << 20
#: A q-gram with so many different surroundings is refined string by string.
COMMON = 5_000
#: Stands for a null id: earlier than all others.
NO_ID = -(1 << 63)

_SPAN = LENGTH - Q  # how far an anchor may lie from its string's start


def identifiers(raw: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` bytes at each position (of the last axis), by doubling.

    Shorter strings' hashes at two offsets make up the longer string's.
    """
    out, size = mixed(raw.astype(np.uint64) + np.uint64(1)), 1
    while size < length and out.size:
        step = min(size, length - size)
        out = mixed(out[..., : max(0, out.shape[-1] - step)] * np.uint64(0x9E3779B97F4A7C15) + out[..., step:])
        size += step
    return out


def _split(at: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in buckets of equal values, and their buckets' numbers from 1; those alone in a bucket drop out."""
    order = np.argsort(values)
    values = values[order]
    fresh = np.ones(len(order) + 1, bool)
    fresh[1:-1] = values[1:] != values[:-1]
    shared = ~(fresh[:-1] & fresh[1:])
    return at[order[shared]], np.cumsum(fresh[:-1], dtype=np.uint32)[shared]


def refined(raw: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose string of ``length`` bytes occurs elsewhere too, and its bucket, by bucket-pointer refinement.

    ``raw`` is made of pieces of ``sizes`` bytes; strings lie within a piece.
    Buckets are exact: those of ``FIRST`` bytes hold equal bytes, and a longer
    string's is the pair of its two parts' buckets.
    """
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(raw))
    words = np.ndarray(len(raw), "<u8", np.concatenate([raw, np.zeros(FIRST, np.uint8)]), strides=(1,))
    at = np.flatnonzero(room >= FIRST)
    at, bucket = _split(at, words[at])
    size = FIRST
    while size < length:
        step = min(size, length - size)
        pointers = np.zeros(len(raw), np.uint32)
        pointers[at] = bucket
        at = np.sort(at)
        at = at[room[at] >= size + step]
        later = pointers[at + step]
        at, later = at[later > 0], later[later > 0]
        at, bucket = _split(at, pointers[at].astype(np.uint64) << np.uint64(32) | later)
        size += step
    return at, bucket


def _sliding(values: np.ndarray, n: int, least=np.minimum) -> np.ndarray:
    """The least of each ``n`` values in a row."""
    size = 1
    while 2 * size <= n:
        values = least(values[:-size], values[size:]) if len(values) > size else values[:0]
        size *= 2
    rest = n - size
    return least(values[: max(0, len(values) - rest)], values[rest:]) if rest else values


def anchors(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
    """``at, q-gram, first, last``: anchors, and the first and last start of the strings each is the anchor of."""
    g = _SPAN + 1
    empty = np.zeros(0, np.int64)
    if len(raw) < LENGTH:
        return empty, empty.astype(np.uint64), empty, empty
    grams = identifiers(raw, Q)
    least = _sliding(grams, g)
    ends = np.repeat(starts[1:], np.diff(starts))[: len(least)]
    inside = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends)
    # the first place of the least gram: from each string's least value, how far on it lies
    place = np.zeros(len(inside), np.int64)
    todo = np.arange(len(inside))
    lows = least[inside]
    # within runs of one minimum the place is shared: find it by the next position with that gram
    candidates = np.flatnonzero(_is_least(grams, least, inside, g))
    nxt = np.searchsorted(candidates, inside)
    while len(todo):
        spot = candidates[nxt[todo]]
        right = grams[spot] == lows[todo]
        place[todo[right]] = spot[right]
        todo = todo[~right]
        nxt[todo] += 1
    change = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else empty
    first = inside[change]
    last = inside[np.concatenate([change[1:], [len(place)]]).astype(np.int64) - 1] if len(change) else empty
    at = place[change]
    return at, grams[at], first, last


def _is_least(grams: np.ndarray, least: np.ndarray, inside: np.ndarray, g: int) -> np.ndarray:
    """Whether a position holds the least gram of any string that it lies in."""
    known = np.zeros(len(least), np.uint64)
    known[inside] = least[inside]
    pad = np.zeros(g - 1, np.uint64)
    return (_sliding(np.concatenate([pad, known, pad]), g, np.maximum) == grams) & (grams > 0)


def _bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys) % np.uint64(buckets)).astype(np.int64)


def _home_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket_of(ids.view(np.uint64) + np.uint64(0x51), buckets)


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "blob"])


def _dealt(buckets: np.ndarray, order_by: np.ndarray, docs: dict[str, np.ndarray], doc: np.ndarray, **arrays: np.ndarray) -> list[tuple[int, bytes]]:
    """A blob for each bucket: the rows by key, and the documents they are of."""
    order = np.lexsort((order_by, buckets))
    cuts = np.flatnonzero(np.diff(buckets[order])) + 1
    out = []
    for part in np.split(order, cuts):
        if len(part):
            used, local = np.unique(doc[part], return_inverse=True)
            columns = {k: a[part] for k, a in arrays.items()}
            out.append((int(buckets[part[0]]), press(**columns, doc=local.astype(np.uint32), **{k: a[used] for k, a in docs.items()})))
    return out


def _digests(text: bytes, first: np.ndarray, stop: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of XXH3 of spans of a text, as two numbers."""
    digest, view = xxhash.xxh3_128_digest, memoryview(text)
    both = np.frombuffer(b"".join([digest(view[a:b], c) for a, b, c in zip(first.tolist(), stop.tolist(), seeds.tolist(), strict=True)]), np.uint64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _texts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and content hashes: together they name a document."""
    ids = batch.column("_id").to_numpy(zero_copy_only=False)
    marks = np.array([xxhash.xxh3_64_intdigest(t or b"") for t in batch.column("text").cast(pa.large_binary()).to_pylist()], np.uint64)
    return ids.astype(np.int64), marks


def _equal(r: dict[str, np.ndarray], ids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of anchors by q-gram, surroundings and place; in it, which repeat a row, and which have no equal one before."""
    order = np.lexsort((r["at"], marks, ids, r["around2"], r["around"], r["key"]))
    first, again = np.ones(len(order), bool), np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    first[1:] = np.logical_or.reduce([r[k][a] != r[k][b] for k in ("key", "around", "around2")])
    # a document that repeats with its id is one document: its rows fold
    again[1:] = ~first[1:] & (ids[a] == ids[b]) & (marks[a] == marks[b]) & (r["at"][a] == r["at"][b])
    return order, again, first


def _send_anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Step 1, by documents: anchors and hashes of their surroundings, to the buckets of their q-grams."""
    held: list[dict[str, np.ndarray]] = []
    size = docs = 0

    def flush() -> pa.RecordBatch:
        h = {k: np.concatenate([x[k] for x in held]) for k in held[0]}
        names = {"ids": h.pop("ids"), "marks": h.pop("marks")}
        order, again, first = _equal(h, names["ids"][h["doc"]], names["marks"][h["doc"]])
        h = {k: a[order][~again] for k, a in h.items()}
        first = first[~again]
        reps, rest = ({k: a[which] for k, a in h.items()} for which in (first, ~first))
        rows = _dealt(_bucket_of(reps["key"], buckets), reps["key"], names, reps.pop("doc"), **reps)
        # all but the earliest of equal anchors are settled: they go where their documents go
        doc = rest["doc"]
        kind = np.zeros(len(doc), np.uint8)
        rows += _dealt(_home_of(names["ids"], buckets)[doc], rest["at"], names, doc, at=rest["at"], back=rest["back"], strings=rest["strings"], kind=kind)
        return _batch(rows)

    for batch in slices(batches, "text"):
        raw, starts = flat(batch.column("text"))
        ids, marks = _texts(batch)
        at, key, first, last = anchors(raw, starts)
        doc = np.searchsorted(starts, at, side="right") - 1
        low, high = np.maximum(at - _SPAN, starts[doc]), np.minimum(at + LENGTH, starts[doc + 1])
        around, around2 = _digests(raw.tobytes(), low, high, at - low)
        held.append({
            "key": key, "around": around, "around2": around2, "at": (at - starts[doc]).astype(np.uint32), "back": (at - first).astype(np.uint8),
            "strings": (last - first).astype(np.uint8), "doc": doc + docs, "ids": ids, "marks": marks,
        })
        docs += len(ids)
        size += len(raw)
        if size >= RUN_BYTES:
            yield flush()
            held, size, docs = [], 0, 0
    if held:
        yield flush()


def _gathered(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """The rows of several blobs, with ``ids`` and ``marks`` for each row."""
    parts = []
    for blob in blobs:
        a = unpress(blob)
        doc = a.pop("doc")
        a["ids"], a["marks"] = a["ids"][doc], a["marks"][doc]
        parts.append(a)
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def _named(rows: dict[str, np.ndarray], keep: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The documents of the kept rows, and each row's place among them."""
    pairs = np.stack([rows["ids"][keep].view(np.uint64), rows["marks"][keep]], axis=1)
    names, doc = np.unique(pairs, axis=0, return_inverse=True) if len(pairs) else (pairs, np.zeros(0, np.int64))
    return {"ids": np.ascontiguousarray(names[:, 0]).view(np.int64), "marks": np.ascontiguousarray(names[:, 1])}, doc.ravel()


def _resolve(table: pa.Table, homes: int) -> pa.Table:
    """Step 1, by buckets: settled anchors (kind 0), those to refine (1), those of common q-grams (2), to the documents' homes.

    Anchors that their run settled have come to the home's bucket already.
    """
    blobs = {True: [], False: []}
    for blob in table.column("blob").to_pylist():
        blobs["key" in unpress(blob)].append(blob)
    here = table.column("bucket")[0].as_py()
    settled = [(here, blob) for blob in blobs[False]]
    if not blobs[True]:
        return pa.Table.from_batches([_batch(settled)])
    r = _gathered(blobs[True])
    order, again, first = _equal(r, r["ids"], r["marks"])
    r = {k: a[order][~again] for k, a in r.items()}
    first = first[~again]
    new_key = np.ones(len(first), bool)
    new_key[1:] = r["key"][1:] != r["key"][:-1]
    group = np.cumsum(new_key) - 1
    several = np.bincount(group, weights=first)[group] if len(group) else np.zeros(0)
    kind = np.where(first, np.where(several > COMMON, 2, 1), 0).astype(np.uint8)
    keep = np.flatnonzero(~first | (several > 1))
    names, doc = _named(r, keep)
    home = _home_of(names["ids"], homes)[doc] if len(keep) else np.zeros(0, np.int64)
    rows = _dealt(home, r["at"][keep], names, doc, at=r["at"][keep], back=r["back"][keep], strings=r["strings"][keep], kind=kind[keep])
    return pa.Table.from_batches([_batch(settled + rows)])


def _homed(batches: Iterator[pa.RecordBatch], homes: int) -> Iterator[pa.RecordBatch]:
    """Documents, compressed, with the number of their home."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        ids = batch.column("_id").to_numpy(zero_copy_only=False).astype(np.int64)
        texts = [press.compress(t) if t else b"" for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(_home_of(ids, homes).astype(np.int32)), batch.column("doc_id"), pa.array(ids), pa.array(texts, pa.binary())], names=["bucket", "doc_id", "_id", "text"]
        )


def _opened(docs: pa.Table) -> Iterator[tuple[int | None, int, int, bytes]]:
    """``doc_id, id, mark, text`` of each document of a home."""
    raw = zstandard.ZstdDecompressor()
    for batch in docs.select(["doc_id", "_id", "text"]).to_batches(max_chunksize=256):
        for doc_id, i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = raw.decompress(text) if text else b""
            yield doc_id, i, xxhash.xxh3_64_intdigest(text), text


def _by_document(r: dict[str, np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """The places of the rows of each document."""
    if not len(r["ids"]):
        return {}
    order = np.lexsort((r["marks"], r["ids"]))
    cuts = np.flatnonzero((np.diff(r["ids"][order]) != 0) | (np.diff(r["marks"][order]) != 0)) + 1
    return {(int(r["ids"][p[0]]), int(r["marks"][p[0]])): p for p in np.split(order, cuts)}


def _send_strings(docs: pa.Table, found: pa.Table, buckets: int) -> pa.Table:
    """Step 2, by documents: the bytes of strings to refine, or their digests where the q-gram is common."""
    if not found.num_rows:
        return pa.Table.from_batches([_batch([])])
    r = _gathered(found.column("blob").to_pylist())
    todo = np.flatnonzero(r["kind"] > 0)
    r = {k: a[todo] for k, a in r.items()}
    of = _by_document(r)
    seen = set()
    names_ids, names_marks = [], []
    text_parts, grams, rows = [], [], []
    common_keys, common_rows = [], []
    for _, i, mark, text in _opened(docs):
        places = of.get((i, mark))
        if places is None or (i, mark) in seen:
            continue
        seen.add((i, mark))
        raw = np.frombuffer(text, np.uint8)
        number = len(names_ids)
        names_ids.append(i)
        names_marks.append(mark)
        at = r["at"][places].astype(np.int64)
        first = at - r["back"][places]
        strings = r["strings"][places].astype(np.int64)
        whole = r["kind"][places] == 1
        grams.append(raw[at[whole][:, None] + np.arange(Q)])
        rows.append(np.column_stack([np.full(whole.sum(), number), first[whole], strings[whole]]))
        text_parts += [text[f : f + n + LENGTH] for f, n in zip(first[whole].tolist(), strings[whole].tolist(), strict=True)]
        n = strings[~whole] + 1
        starts = np.repeat(first[~whole] - np.cumsum(n) + n, n) + np.arange(n.sum())
        if len(starts):
            common_keys.append(_digests(text, starts, starts + LENGTH, np.zeros_like(starts)))
            common_rows.append(np.column_stack([np.full(len(starts), number), starts]))
    names = {"ids": np.array(names_ids, np.int64), "marks": np.array(names_marks, np.uint64)}
    out: list[tuple[int, bytes]] = []
    if text_parts:
        keys = identifiers(np.concatenate(grams), Q)[:, 0]
        doc, first, strings = np.concatenate(rows).T
        bucket = _bucket_of(keys, buckets)
        order = np.lexsort((keys, bucket))
        for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            used, local = np.unique(doc[part], return_inverse=True)
            blob = press(
                key=keys[part], at=first[part].astype(np.uint32), strings=strings[part].astype(np.uint8), doc=local.astype(np.uint32),
                text=np.frombuffer(b"".join(text_parts[p] for p in part.tolist()), np.uint8), **{k: a[used] for k, a in names.items()},
            )
            out.append((int(bucket[part[0]]), blob))
    if common_keys:
        keys, keys2 = map(np.concatenate, zip(*common_keys, strict=True))
        pairs = np.concatenate(common_rows)
        out += _dealt(_bucket_of(keys, buckets), keys, names, pairs[:, 0], key=keys, key2=keys2, at=pairs[:, 1].astype(np.uint32))
    return pa.Table.from_batches([_batch(out)])


def _later(ids: np.ndarray, marks: np.ndarray, at: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of the strings with equal keys all but the earliest."""
    order = np.lexsort((at, marks, ids, *keys))
    later = np.zeros(len(order), bool)
    later[1:] = np.logical_and.reduce([k[order[1:]] == k[order[:-1]] for k in keys])
    keep = order[later]
    return ids[keep], marks[keep], at[keep]


def _refine_pieces(blobs: list[dict[str, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
    """The later ones of equal strings in pieces of text, some q-grams at a time."""
    text = np.concatenate([a["text"] for a in blobs])
    r = {k: np.concatenate([a[k] for a in blobs]) for k in ("key", "at", "strings")}
    r |= {k: np.concatenate([a[k][a["doc"]] for a in blobs]) for k in ("ids", "marks")}
    sizes = r["strings"].astype(np.int64) + LENGTH
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(r["key"], kind="stable")
    key, done = r["key"][order], np.cumsum(sizes[order])
    # parts end where a q-gram ends
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
    part = done[ends - 1] // PART
    ends = ends[np.append(part[1:] != part[:-1], True)]
    for rows in np.split(order, ends[:-1]):
        n = sizes[rows]
        own = np.cumsum(n) - n
        at, bucket = refined(text[np.repeat(begins[rows] - own, n) + np.arange(n.sum())], n, LENGTH)
        piece = np.searchsorted(own, at, side="right") - 1
        row = rows[piece]
        yield _later(r["ids"][row], r["marks"][row], r["at"][row].astype(np.int64) + at - own[piece], bucket)


def _refine(table: pa.Table, homes: int) -> pa.Table:
    """Step 2, by buckets: the strings that also start earlier, to the documents' homes."""
    pieces, common = [], []
    for blob in table.column("blob").to_pylist():
        a = unpress(blob)
        (pieces if "text" in a else common).append(a)
    found = list(_refine_pieces(pieces)) if pieces else []
    if common:
        c = {k: np.concatenate([a[k] for a in common]) for k in ("key", "key2", "at")}
        c |= {k: np.concatenate([a[k][a["doc"]] for a in common]) for k in ("ids", "marks")}
        found.append(_later(c["ids"], c["marks"], c["at"].astype(np.int64), c["key"], c["key2"]))
    ids, marks, at = map(np.concatenate, zip(*found, strict=True))
    keep = np.arange(len(at))
    names, doc = _named({"ids": ids, "marks": marks}, keep)
    home = _home_of(names["ids"], homes)[doc] if len(keep) else np.zeros(0, np.int64)
    begins = at
    # runs of neighbouring strings go as one row
    by = np.lexsort((begins, doc))
    doc, begins, home = doc[by], begins[by], home[by]
    fresh = np.ones(len(by), bool)
    fresh[1:] = (doc[1:] != doc[:-1]) | (begins[1:] != begins[:-1] + 1)
    head = np.flatnonzero(fresh)
    length = np.diff(np.append(head, len(by)))
    out = _dealt(home[head], begins[head], names, doc[head], at=begins[head].astype(np.uint32), many=length.astype(np.uint32))
    return pa.Table.from_batches([_batch(out)])


def _cut(docs: pa.Table, found: pa.Table, with_text: bool) -> pa.Table:
    """Step 3: what is left of each document of a home."""
    parts = []
    for blob in found.column("blob").to_pylist():
        a = _gathered([blob])
        if "kind" in a:
            settled = a["kind"] == 0
            first = a["at"].astype(np.int64) - a["back"]
            parts.append((a["ids"][settled], a["marks"][settled], first[settled], (first + a["strings"] + LENGTH)[settled]))
        else:
            first = a["at"].astype(np.int64)
            parts.append((a["ids"], a["marks"], first, first + a["many"] - 1 + LENGTH))
    r = dict(zip(("ids", "marks", "first", "stop"), map(np.concatenate, zip(*parts, strict=True)), strict=True)) if parts else {"ids": ()}
    of = _by_document(r)
    rows = []
    for doc_id, i, mark, text in _opened(docs):
        places = of.get((i, mark))
        removed = spans = 0
        if places is not None:
            order = places[np.argsort(r["first"][places], kind="stable")]
            kept, done, begin = [], 0, -1
            for f, s in zip(r["first"][order].tolist(), r["stop"][order].tolist(), strict=True):
                if begin < 0 or f > done:
                    kept.append(text[max(done, 0) : f])
                    spans += 1
                    begin, done = f, max(done, s)
                    removed += s - f
                elif s > done:
                    removed += s - done
                    done = s
            kept.append(text[done:])
            left = b"".join(kept)
        else:
            left = text
        rows.append((doc_id, len(text), removed, spans, hashlib.sha256(left).hexdigest(), left if with_text else None))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.table([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame, with_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for each row of ``docs`` (``doc_id``, ``text``).

    Every byte goes that a ``LENGTH``-byte string covers which also starts
    earlier: in a smaller ``doc_id``, or earlier in the document.  Strings are
    judged on the input.  ``kept`` is binary, as cuts may part a character.

    Null and empty texts have no bytes.  Null ids come before all others, and an
    id of ``NO_ID`` itself counts as one.  An empty table gives an empty table.
    A text is handled in one piece, with some 150 bytes of memory a byte.  Rows
    that repeat an id and a text count as one document and are cut alike; those
    that repeat an id with another text are documents of their own, in the order
    of a hash of their texts.  Other columns are not read.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), "text")
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = bucket_count(size, BUCKET_BYTES)
    kind = "bucket int, blob binary"
    sent = narrow.select("_id", "text").mapInArrow(lambda b: _send_anchors(b, n), kind)
    found = materialise(sent.groupBy("bucket").applyInArrow(lambda t: _resolve(t, n), kind), "anchors")
    homed = narrow.mapInArrow(lambda b: _homed(b, n), "bucket int, doc_id long, _id long, text binary")
    strings = homed.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(lambda d, f: _send_strings(d, f, n), kind)
    later = strings.groupBy("bucket").applyInArrow(lambda t: _refine(t, n), kind)
    cuts = found.unionByName(later)
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return homed.groupBy("bucket").cogroup(cuts.groupBy("bucket")).applyInArrow(lambda d, f: _cut(d, f, with_text), result)


def query(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False).drop("kept")
