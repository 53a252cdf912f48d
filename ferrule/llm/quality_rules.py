"""Quality rules: how much of a text lies inside repeated n-grams and lines.

Words and lines become 64-bit hashes; those of n-grams roll along the words' by
doubling, for all texts of a batch at once in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import _SPACE, flat, mixed, runs_of, slices, span_hashes, word_bounds

#: Largest share of a text's word characters inside n-grams found twice or more, by n.
NGRAM_SHARES = {5: 0.25, 6: 0.24, 7: 0.23, 8: 0.22, 9: 0.21, 10: 0.20}
#: Largest share of a text's word characters inside lines equal to another line of the text.
LINE_SHARE = 0.30
#: Largest number of symbols to a word.
SYMBOLS_PER_WORD = 0.10
FEWEST_WORDS = 10
MOST_REPEATED_PERCENT = 20
BASE_N = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ngram_share double, line_share double"


def _sums(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def _groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it is found twice or more; whether it came earlier."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = np.zeros(len(keys), bool)
    same[1:] = ordered[1:] == ordered[:-1]
    twice = same.copy()
    twice[:-1] |= same[1:]
    repeated, later = np.empty(len(keys), bool), np.empty(len(keys), bool)
    repeated[order], later[order] = twice, same
    return repeated, later


def _covered(repeated: np.ndarray, at: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie in a repeated window of ``n`` words."""
    marks = np.zeros(words + 1, np.int32)
    begins = at[repeated]
    np.add.at(marks, begins, 1)
    np.add.at(marks, begins + n, -1)
    return np.cumsum(marks[:-1]) > 0


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts and shares of each text of an Arrow column; null counts as empty."""
    raw, starts = flat(column)
    docs = len(starts) - 1
    word_byte = ~_SPACE[raw]
    first, last = word_bounds(raw, starts)
    chars = _sums(word_byte & ((raw & 0xC0) != 0x80))
    of_word = np.searchsorted(first, starts)
    n_words = np.diff(of_word)
    doc_of = np.repeat(np.arange(docs), n_words)
    out = {"n_words": n_words, "word_chars": np.diff(chars[starts]), "n_symbols": np.diff(_sums(_SYMBOL[raw])[starts])}

    breaks = np.flatnonzero(raw == 10)
    line_from = np.concatenate([starts[:-1], breaks + 1])
    line_doc = np.concatenate([np.arange(docs), np.searchsorted(starts, breaks, side="right") - 1])
    order = np.lexsort((line_from, line_doc))
    line_from, line_doc = line_from[order], line_doc[order]
    line_to = np.concatenate([line_from[1:] - 1, [0]]) if len(line_from) else line_from
    is_last = np.ones(len(line_doc), bool)
    is_last[:-1] = line_doc[1:] != line_doc[:-1]
    line_to[is_last] = starts[1:][line_doc[is_last]]
    line_chars = chars[line_to] - chars[line_from]
    full = line_chars > 0
    line_doc, line_chars = line_doc[full], line_chars[full]
    keys = span_hashes(raw, line_from[full], line_to[full]) ^ mixed(line_doc.astype(np.uint64))
    repeated, later = _groups(keys)
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=docs)
    whole = np.maximum(out["word_chars"], 1)
    out["line_share"] = np.bincount(line_doc[repeated], weights=line_chars[repeated], minlength=docs) / whole

    word_hash = span_hashes(raw, first, last)
    word_chars = chars[last] - chars[first]
    salt = mixed(doc_of.astype(np.uint64))
    worst = np.zeros(docs)
    for n in sorted({BASE_N, *NGRAM_SHARES}):
        at = np.arange(max(0, len(first) - n + 1))
        at = at[doc_of[at] == doc_of[at + n - 1]] if len(at) else at
        repeated, _ = _groups(runs_of(word_hash, n)[at] ^ salt[at])
        inside = _covered(repeated, at, n, len(first))
        if n == BASE_N:
            out["n_repeat_words"] = np.bincount(doc_of[inside], minlength=docs)
        if n in NGRAM_SHARES:
            share = np.bincount(doc_of[inside], weights=word_chars[inside], minlength=docs) / whole
            worst = np.maximum(worst, share / NGRAM_SHARES[n])
    out["ngram_share"] = worst
    return out


def _score(batches: Iterator[pa.RecordBatch], id_column: str, text_column: str) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, text_column):
        m = measure(batch.column(text_column))
        failed = (m["n_words"] < FEWEST_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED_PERCENT * m["n_words"])
        kept = ~failed & (m["ngram_share"] <= 1) & (m["line_share"] <= LINE_SHARE) & (m["n_symbols"] <= SYMBOLS_PER_WORD * m["n_words"])
        whole = [pa.array(m[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
        yield pa.RecordBatch.from_arrays(
            [batch.column(id_column), *whole, pa.array(failed), pa.array(kept), pa.array(m["ngram_share"]), pa.array(m["line_share"])],
            names=[id_column, *(x.split()[0] for x in SCHEMA.split(", "))],
        )


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: word, symbol and repetition counts, and whether the text passes.

    ``base_failed``: under 10 words, or over 20 % of the words in 5-word windows
    found twice or more.  ``kept``: not failed, no n-gram length of
    ``NGRAM_SHARES`` covers more than its share of the word characters
    (``ngram_share``: the worst, as a multiple of its limit), no more than
    ``LINE_SHARE`` of them in repeated lines, no more than ``SYMBOLS_PER_WORD``.

    Null and empty texts have no words and fail.  Null ids and repeated rows
    pass through, row by row; other columns are not read.  An empty table gives
    an empty table.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(lambda b: _score(b, id_column, text_column), f"`{id_column}` {kind}, {SCHEMA}")


def query(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
