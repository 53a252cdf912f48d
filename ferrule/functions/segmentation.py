"""Words of text written without blanks: the likeliest cut into the words of a dictionary.

A dictionary is a table of words and how often each is met.  A run of a script's
characters is cut so that the product of its words' shares is greatest; of equal
cuts the one whose first word is longer.  A character that no word covers stays alone and
counts as met once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrule.sources.scratch import materialise

#: Characters of scripts written without blanks.
HAN = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
#: Letters of all words of a dictionary that a task may hold; larger dictionaries are joined (``cuts``).
MOST_LETTERS = 20_000_000
#: Longer entries of a dictionary are no words and are left out.
LONGEST = 64


@dataclass
class Lexicon:
    #: ``word, weight``: each word once, with the logarithm of its share
    words: DataFrame
    #: The weight of a character alone.
    alone: float
    #: Lengths that words have, in order.
    lengths: list[int]
    letters: int


def lexicon(dictionary: DataFrame, longest: int = LONGEST) -> Lexicon:
    """A dictionary (``word, n``) made ready.

    Words are lower-cased.  Null and empty words are left out, as are those of more
    than ``longest`` characters; a word listed several times counts as often as its
    highest ``n``, and one without ``n``, or with less than one, once.  Other
    columns are not read.  An empty dictionary leaves every character alone.
    """
    n = F.greatest(F.coalesce(F.col("n").cast("double"), F.lit(1.0)), F.lit(1.0))
    counted = dictionary.select(F.lower(F.col("word").cast("string")).alias("word"), n.alias("n")).where(F.length("word").between(1, longest))
    counted = materialise(counted.groupBy("word").agg(F.max("n").alias("n")), "lexicon")
    size = F.length("word")
    row = counted.agg(F.sum("n").alias("n"), F.sum(size).alias("letters"), F.array_sort(F.collect_set(size)).alias("lengths")).first()
    total = math.log(row["n"] or 1.0)
    return Lexicon(counted.select("word", (F.log("n") - F.lit(total)).alias("weight")), -total, list(row["lengths"]), row["letters"] or 0)


def cut(run: str, at: Callable[[int], Iterable[tuple[int, float]]], alone: float) -> list[str]:
    """Cut ``run``, where ``at(i)`` gives lengths and weights of the words that begin at ``i``."""
    n = len(run)
    best, step = [0.0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        best[i], step[i] = max([(alone + best[i + 1], 1)] + [(w + best[i + k], k) for k, w in at(i)])
    out, i = [], 0
    while i < n:
        out.append(run[i : i + step[i]])
        i += step[i]
    return out


def tokens(text: Column | str, script: str = HAN) -> Column:
    """Lower-case words, runs of ``script`` whole."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[{script}]+|[[\p{{L}}\p{{N}}_]&&[^{script}]]+"), F.lit(0))


def tokeniser(lexicon: Lexicon, script: str = HAN) -> Callable[[Column], Column]:
    """A tokenizer for the slot of that name: words of a text, runs of ``script`` cut by the dictionary.

    The dictionary is broadcast; one of over ``MOST_LETTERS`` letters is refused
    (``cuts`` joins such).  Texts without the script do not leave the JVM.  A null
    text has null words, an empty one none.
    """
    if lexicon.letters > MOST_LETTERS:
        raise ValueError(f"{lexicon.letters} letters of a dictionary are too many to broadcast (at most {MOST_LETTERS}): join it by cuts")
    found = lexicon.words.toArrow()
    weights = dict(zip(found["word"].to_pylist(), found["weight"].to_pylist(), strict=True))
    held = lexicon.words.sparkSession.sparkContext.broadcast(weights)
    alone, lengths = lexicon.alone, lexicon.lengths

    @F.pandas_udf("array<string>")
    def cut_all(rows: pd.Series) -> pd.Series:
        weights, is_run = held.value, regex.compile(f"[{script}]").match
        known: dict[str, list[str]] = {}

        def parts(token: str) -> list[str]:
            if token not in known:
                at = lambda i: [(k, weights[token[i : i + k]]) for k in lengths if i + k <= len(token) and token[i : i + k] in weights]
                known[token] = cut(token, at, alone) if is_run(token) else [token]
            return known[token]

        return rows.map(lambda row: None if row is None else [w for token in row for w in parts(token)])

    def tokenise(text: Column | str) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        whole = tokens(text, script)
        return F.coalesce(cut_all(F.when(text.rlike(f"[{script}]"), whole)), whole)

    return tokenise


def cuts(texts: DataFrame, lexicon: Lexicon, script: str = HAN) -> DataFrame:
    """``run, words`` of each different run of ``script`` in ``texts`` (``text``), for dictionaries of any size.

    Pieces of runs, of the lengths that words have, meet the dictionary in a join, so
    neither passes one machine; what gathers in one row is a run and the words in it.
    Null and empty texts have no runs.
    """
    found = texts.select(F.explode(F.filter(tokens("text", script), lambda t: t.rlike(f"[{script}]"))).alias("run"))
    runs = materialise(found.distinct(), "runs")
    longest = lexicon.lengths[-1] if lexicon.lengths else 1
    letters = runs.select("run", F.split("run", "").alias("letters"))
    starts = letters.select("run", F.posexplode(F.transform("letters", lambda _, i: F.array_join(F.slice("letters", i + 1, longest), ""))).alias("at", "start"))
    piece = F.explode(F.filter(F.array(*map(F.lit, lexicon.lengths)).cast("array<int>"), lambda k: k <= F.length("start")))
    pieces = starts.select("run", "at", "start", piece.alias("size")).select("run", "at", "size", F.substring("start", F.lit(1), F.col("size")).alias("word"))
    edges = pieces.join(lexicon.words, "word").groupBy("run").agg(F.collect_list("at").alias("ats"), F.collect_list("size").alias("sizes"), F.collect_list("weight").alias("weights"))
    alone = lexicon.alone

    @F.pandas_udf("array<string>")
    def cut_by_edges(run: pd.Series, ats: pd.Series, sizes: pd.Series, weights: pd.Series) -> pd.Series:
        out = []
        for r, *found in zip(run, ats, sizes, weights, strict=True):
            by: dict[int, list[tuple[int, float]]] = {}
            for a, k, w in zip(*found, strict=True) if found[0] is not None else ():
                by.setdefault(int(a), []).append((int(k), float(w)))
            out.append(cut(r, lambda i, by=by: by.get(i, ()), alone))
        return pd.Series(out)

    return runs.join(edges, "run", "left").select("run", cut_by_edges("run", "ats", "sizes", "weights").alias("words"))
