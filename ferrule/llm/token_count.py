"""Token counts: the best unigram segmentation of each pre-token, shared along a trie.

Distinct pre-tokens go into a trie.  A node holds the forward score of its
prefix, which depends on the prefix alone, so that each shared prefix is scored
once; a word's last node holds its token count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import slices, texts_of

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"
#: Marks the start of a word in the vocabulary.
START = "▁"
#: Subtracted from the lowest score for a character that no piece covers.
FALLBACK = 10.0
#: A trie of so many nodes is given up for an empty one; counts do not depend on it.
MOST_NODES = 600_000
#: Longer words are scored by themselves, without a node for each character.
LONGEST = 1_000


def vocabulary(path: str = TOKENIZER) -> dict[str, float]:
    """Pieces of a SentencePiece file with unigram log-probabilities.

    The public file ranks its pieces but gives them no probabilities; by Zipf's
    law the piece of rank r has one in proportion to 1 / (r + 2.7).
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 2.7) for r in range(len(kept))))
    return {model.id_to_piece(i): -math.log(r + 2.7) - total for r, i in enumerate(kept)}


_NO_END = object()


class Trie:
    """Forward scores and token counts of word prefixes."""

    def __init__(self, scores: dict[str, float]):
        #: Ends of pieces, with the score of those that are pieces: what no piece ends in is not looked at further.
        self.ends: dict[str, float | None] = {p[i:]: None for p in scores for i in range(len(p))} | scores
        self.unknown = min(scores.values(), default=0.0) - FALLBACK
        self.clear()

    def clear(self) -> None:
        self.next: dict[tuple[int, str], int] = {}
        self.best, self.tokens = [0.0], [0]
        self.done: dict[bytes, int] = {}

    def count(self, word: bytes) -> int:
        """Tokens of one word."""
        found = self.done.get(word)
        if found is None:
            if len(self.best) > MOST_NODES:
                self.clear()
            found = self._insert(START + word.decode())
            if len(word) <= LONGEST:
                self.done[word] = found
        return found

    def _insert(self, word: str) -> int:
        nxt, ends = self.next, self.ends
        best, tokens = [0.0], [0]
        stored = len(word) <= LONGEST
        node = at = 0
        if stored:
            while at < len(word) and (child := nxt.get((node, word[at]))) is not None:
                node = child
                best.append(self.best[node])
                tokens.append(self.tokens[node])
                at += 1
        for j in range(at + 1, len(word) + 1):
            top, few = best[j - 1] + self.unknown, tokens[j - 1] + len(word[j - 1].encode())
            for k in range(j - 1, -1, -1):
                score = ends.get(word[k:j], _NO_END)
                if score is _NO_END:
                    break
                if score is not None:
                    score += best[k]
                    if score > top or (score == top and tokens[k] + 1 < few):
                        top, few = score, tokens[k] + 1
            best.append(top)
            tokens.append(few)
            if stored:
                self.best.append(top)
                self.tokens.append(few)
                child = len(self.best) - 1
                nxt[node, word[j - 1]] = child
                node = child
        return tokens[-1]


def _count(batches: Iterator[pa.RecordBatch], scores) -> Iterator[pa.RecordBatch]:
    trie = Trie(scores.value)
    for batch in slices(batches, "text"):
        n_words, n_tokens = [], []
        for text in texts_of(batch.column("text")):
            words = text.split()
            n_words.append(len(words))
            n_tokens.append(sum(map(trie.count, words)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["doc_id", "n_words", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    r"""``doc_id, n_words, n_tokens`` for each row of ``docs``.

    Pre-tokens are the words ``[^\x20\x09-\x0D]+``, each with the mark of a word
    start before it.  A word's tokens are those of its segmentation with the
    highest sum of log-probabilities, of equal ones the shortest; a character
    that no piece covers takes one token for each of its UTF-8 bytes.

    Null, empty and blank texts have no tokens.  Null ids and repeated rows pass
    through, row by row; other columns are not read.  An empty table gives an
    empty table.  A text is split in one piece; a word of over ``LONGEST``
    characters is scored by itself, exactly, and not kept.  What is broadcast is
    the vocabulary, whose size is fixed by its file.
    """
    scores = docs.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _count(b, scores), "doc_id long, n_words long, n_tokens long")


def query(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
