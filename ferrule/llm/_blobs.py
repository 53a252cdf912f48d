"""Compressed arrays, as tasks send them to each other."""

from __future__ import annotations

import numpy as np
import zstandard

_NUMBERS = {"u1": np.uint8, "u2": np.uint16, "u4": np.uint32, "u8": np.uint64, "i8": np.int64, "f4": np.float32, "f8": np.float64}


def press(**arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value; sorted 64-bit keys shrink as differences."""
    parts, head = [], []
    for name, a in arrays.items():
        if name == "key":
            a = np.diff(a, prepend=np.uint64(0))
        kind = next(k for k, t in _NUMBERS.items() if a.dtype == t)
        if kind[0] == "u" and len(a):  # in the narrowest type that holds them
            a = a.astype(np.min_scalar_type(a.max()))
        # bytes of the same weight stand together, so that small numbers shrink
        body = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
        head.append(f"{name}:{kind}:{len(a)}:{a.dtype.itemsize}")
        parts.append(body)
    title = ",".join(head).encode()
    return zstandard.ZstdCompressor(level=3).compress(len(title).to_bytes(4, "little") + title + b"".join(parts))


def unpress(blob: bytes) -> dict[str, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    at = 4 + int.from_bytes(raw[:4], "little")
    out = {}
    for entry in raw[4:at].decode().split(","):
        name, kind, n, width = entry.split(":")
        size = int(n) * int(width)
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8, size, at).reshape(int(width), int(n)).T).view(f"{kind[0]}{width}").ravel().astype(_NUMBERS[kind], copy=False)
        out[name] = np.cumsum(a, dtype=np.uint64) if name == "key" else a
        at += size
    return out


#: A small input is still dealt to so many buckets, of about a megabyte at least.
FEWEST_BUCKETS = 64


def bucket_count(size: int, target: int) -> int:
    """Buckets for so many bytes of texts: of ``target`` bytes, or more and smaller ones where that would leave tasks idle."""
    return max(1, -(-size // target), min(FEWEST_BUCKETS, size >> 20))
