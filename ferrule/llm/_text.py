"""Byte-level text rules that the operators share, for Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_UPPER, _LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: A-Z to a-z, all else as it is.
LOWER = bytes.maketrans(_UPPER, _LOWER)
#: A-Z to a-z; every ASCII byte that is no letter or digit to a space.
ALNUM = bytes.maketrans(
    bytes(c for c in range(128) if not chr(c).isalnum()) + _UPPER,
    b" " * sum(not chr(c).isalnum() for c in range(128)) + _LOWER,
)
#: Bytes of texts that are handled at a time.
SLICE_BYTES = 1 << 20


def space_words(text: bytes) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of a text, A-Z in lower case."""
    return text.translate(LOWER).split()


def alnum_words(text: bytes) -> list[bytes]:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of a text, A-Z in lower case."""
    return text.translate(ALNUM).split()


def code_points(text: bytes) -> int:
    """Characters of a UTF-8 text."""
    return len(text) if text.isascii() else len(text.decode())


def texts_of(column: pa.Array) -> list[bytes]:
    """The texts as bytes; null as the empty text."""
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``most`` bytes of texts, and a row at least."""
    for batch in batches:
        ends = np.cumsum(sliced_sizes(batch.column(text)))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and where each text starts (one more at the end)."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    buffers = column.buffers()
    starts = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(buffers[2], dtype=np.uint8)[starts[0] : starts[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return raw, starts - starts[0]


def sliced_sizes(column: pa.Array) -> np.ndarray:
    """The length of each text in bytes."""
    return np.diff(flat(column)[1])


def mixed(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values: each bit of the input reaches all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: The first 0 to 8 bytes of a little-endian number.
_HEAD = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Longer spans are hashed one by one.
_LONG_SPAN = 512


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of the spans ``[start, end)`` of an array of bytes; the same content has the same hash anywhere.

    Eight bytes at a time are scrambled into the hash, all spans at once, so
    that no two contents collide by their form; spans of over 512 bytes take XXH3.
    """
    sizes = ends - starts
    out = mixed(sizes.astype(np.uint64) + np.uint64(seed) * _FACTOR)
    if not len(sizes):
        return out
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    words = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    which = np.flatnonzero((sizes > 0) & (sizes <= _LONG_SPAN))
    at, left = starts[which], sizes[which]
    while len(which):
        out[which] = mixed((out[which] ^ (words[at] & _HEAD[np.minimum(left, 8)])) * _FACTOR)
        more = left > 8
        which, at, left = which[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(sizes > _LONG_SPAN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]], seed)
    return out


def runs_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` hashes in a row, by doubling: those of shorter runs at two offsets make up a longer one's."""
    out, size = mixed(hashes ^ _FACTOR), 1
    while size < n and len(out):
        step = min(size, n - size)
        out = mixed(mixed(out[: max(0, len(out) - step)]) * _FACTOR + out[step:])
        size += step
    return out


_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def word_bounds(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    r"""First byte and end of each word ``[^\x20\x09-\x0D]+``; no word goes on into the next text."""
    inside = ~_SPACE[raw]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    heads = starts[:-1][starts[:-1] < len(raw)]
    begins[heads] = inside[heads]
    tails = starts[1:][starts[1:] > 0] - 1
    stops[tails] = inside[tails]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1
