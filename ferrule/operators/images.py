"""Page images as binary columns: size, ink, edges, turns.

Sizes are read from JPEG headers.  Pixels are read of netpbm images (P5, P6),
which need no decoder; other formats are a slot's concern, and are null here.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gray below this is ink; the longer edge that pages are shrunk to; a strong row's energy, in means.
DARK, EDGE, STRONG = 180, 512, 1.5

_HEADER = re.compile(rb"\A(P[56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", re.S)
#: JPEG segments that hold a frame's size.
_FRAMES = {*range(0xC0, 0xD0)} - {0xC4, 0xC8, 0xCC}


def jpeg_extent(content: bytes) -> tuple[int, int] | None:
    """Width and height in a JPEG's header, without a look at its pixels."""
    if content[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(content):
        if content[at] != 0xFF:
            return None
        kind = content[at + 1]
        if kind == 0xFF:  # a byte that fills up
            at += 1
        elif kind in _FRAMES:
            return int.from_bytes(content[at + 7 : at + 9], "big"), int.from_bytes(content[at + 5 : at + 7], "big")
        elif kind == 0x01 or 0xD0 <= kind <= 0xD8:  # without a length
            at += 2
        else:
            at += 2 + int.from_bytes(content[at + 2 : at + 4], "big")
    return None


def _pixels(content: bytes) -> tuple[np.ndarray, int] | None:
    """The values of a netpbm image by row, column and channel, and the highest value there may be."""
    head = _HEADER.match(content)
    if not head:
        return None
    width, height, most = (int(x) for x in head.groups()[1:])
    depth = 3 if head[1] == b"P6" else 1
    size = width * height * depth
    if len(content) - head.end() < size or not 0 < most < 256:
        return None
    return np.frombuffer(content, np.uint8, size, head.end()).reshape(height, width, depth), most


def gray(content: bytes) -> np.ndarray | None:
    """A netpbm image as gray levels."""
    found = _pixels(content)
    if found is None:
        return None
    levels = found[0].astype(np.float64) * (255 / found[1])
    return levels[:, :, 0] if levels.shape[2] == 1 else levels @ np.array([0.299, 0.587, 0.114])


def dark(content: bytes) -> np.ndarray | None:
    """Where a netpbm image's gray levels are ink."""
    found = _pixels(content)
    if found is None or found[0].shape[2] == 3:
        return None if found is None else gray(content) < DARK
    return found[0][:, :, 0] < _lightest(found[1])


@cache
def _lightest(most: int) -> int:
    """The least value that is no ink."""
    return int(np.searchsorted(np.arange(256) * (255 / most), DARK))


def shrunk(levels: np.ndarray, edge: int = EDGE) -> np.ndarray:
    """Levels averaged down so that the longer edge has at most ``edge`` of them."""
    for axis in (0, 1):
        size = levels.shape[axis]
        to = max(1, round(size * min(1.0, edge / max(levels.shape))))
        if 0 < to < size:
            cuts = np.arange(to) * size // to
            widths = np.diff(np.append(cuts, size))
            levels = np.add.reduceat(levels, cuts, axis=axis) / (widths[:, None] if axis == 0 else widths[None, :])
    return levels


def ink(content: bytes) -> tuple[float, float] | None:
    """The share of dark pixels, and of rows with many edges."""
    levels = gray(content)
    if levels is None:
        return None
    if not levels.size:
        return 0.0, 0.0
    levels = shrunk(levels)
    padded = np.pad(levels, 1, mode="edge")
    around = sum(padded[1 + i : 1 + i + levels.shape[0], 1 + j : 1 + j + levels.shape[1]] for i in (-1, 0, 1) for j in (-1, 0, 1))
    energy = np.clip(9 * levels - around, 0, 255).sum(axis=1)
    return float((levels < DARK).mean()), float((energy > STRONG * energy.mean()).mean())


def turned(content: bytes, degrees: int) -> bytes | None:
    """A netpbm image turned left by a multiple of 90 degrees; no turn gives the same bytes."""
    if degrees % 90:
        raise ValueError("turns are multiples of 90 degrees")
    if degrees % 360 == 0:
        return content
    levels = gray(content)
    if levels is None:
        return None
    out = np.rot90(levels, degrees // 90)
    return b"P5\n%d %d\n255\n" % (out.shape[1], out.shape[0]) + np.round(out).astype(np.uint8).tobytes()


def _of(f, kind: str):
    def run(content: pd.Series) -> pd.DataFrame:
        rows = [None if x is None else f(bytes(x)) for x in content]
        return pd.DataFrame([r or (None, None) for r in rows], columns=kind.replace(",", "").split()[::2])

    run.__annotations__ = {"content": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, kind)


def extent(content: Column) -> Column:
    """``width, height`` of JPEG images; null where the header cannot be read."""
    return _of(jpeg_extent, "width int, height int")(content)


def signals(content: Column) -> Column:
    """``dark, strong_rows`` of netpbm images; null where pixels cannot be read."""
    return _of(ink, "dark double, strong_rows double")(content)


def turn(content: Column, degrees: Column) -> Column:
    """Each image turned by its row's degrees (null: none); null where pixels cannot be read."""

    def run(content: pd.Series, degrees: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else turned(bytes(c), 0 if d is None or d != d else int(d)) for c, d in zip(content, degrees, strict=True)], dtype=object)

    run.__annotations__ = {"content": pd.Series, "degrees": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")(content, degrees)
