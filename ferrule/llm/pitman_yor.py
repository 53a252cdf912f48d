"""LM scoring with a hierarchical Pitman-Yor model.

Three levels of Chinese restaurants: one for each pair of words that was seen
before a word, its parent for the second word of the pair, theirs the root, over
a uniform base.  A dish's tables are its customers at the parent.  Every context
seen has its restaurant; none is shared by a class of words.

Seating is sampled by Gibbs: the customers of a dish sit down anew, the number
of their tables drawn from its distribution given all else.  Table sizes are
integrated out with generalised Stirling numbers.  Predictive probabilities are
averaged over samples, each taken from seats and totals of one state, so that
each is a distribution.  In each sample all seats are drawn anew: restaurants of one
bucket are swept again between samples; of restaurants that several buckets share
(below) all samples are seated side by side, in the same rounds; owners draw a
seating of the root for each sample, all with the customers of the last round.

1. Runs of documents send their distinct trigrams to buckets, by the middle
   word, so that its restaurant and those of its pairs are in one task.  A word
   with more than a bucket's share of the tokens is split by the word after it.
2. Buckets seat their customers, at first with a root of their own, and send what
   they add to open restaurants (the root, and those of split words) to the
   owners of its parts, who sum it, seat the root and send back totals; in
   ``ROUNDS`` rounds, in each of which all seats are sampled again.  How a bucket is
   seated meanwhile comes back with the totals.
3. Buckets answer each run with a probability for each of its trigrams.
4. Runs sum the answers over their documents.

Steps 2 to 4 read one and the same exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._blobs import bucket_count, press, unpress
from ._scratch import materialise
from ._text import LOWER, flat, mixed, slices, span_hashes, word_bounds

#: Discount and strength of the root, of words, of pairs of words.
ROOT, WORD, PAIR = (0.6, 10.0), (0.8, 5.0), (0.9, 1.0)
#: Sweeps of a bucket by itself; rounds of sums over all buckets; samples after the last round.
BURN_IN, ROUNDS, SAMPLES = 2, 2, 4
#: So many customers' weights are multiplied as they are; those of more are summed as logarithms.
DIRECT = 16
#: A restaurant's dishes are seated in so many turns, each with the totals that the last one left.
TURNS = 4
#: Exact Stirling ratios go so far; beyond, their limit.
STIRLING = 256
#: Numbers of tables that are weighed for a dish of more than ``STIRLING`` customers; dishes times tables at a time.
GRID, BLOCK = 256, 1 << 18
#: Logarithms are sent in whole numbers of such a part of one, so that a token's is off by half of it at most.
FINE = float(1 << 14)
SEED = 20_262
FOLDS, HELD_OUT = 7, 2
RUN_BYTES = 8 << 20
#: Bytes of texts that are tokenised at a time, to stay within a processor's cache.
SLICE_BYTES = 1 << 19
#: Bytes of texts to a bucket, about.
TASK_BYTES = 6 << 20
#: Bytes of texts, about, whose words settle the two below; nothing else is learned from this sample.
SAMPLE_BYTES = 64 << 20
#: So many words are sent by number instead of by hash.
NUMBERED = 1 << 18
#: The farther word of a context is known by so much of its hash.
_FAR = np.uint64((1 << 48) - 1)

#: Stand for the end of a text as a word, and for its start as a context.
END, BEGIN = np.uint64(0x5EED0E4D5EED0E4D), np.uint64(0x5EED0B615EED0B61)
_LOWER = np.frombuffer(LOWER, np.uint8)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def held_out(column: str = "doc_id"):
    """Whether a document is not learned from; a null id is learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of a column's texts, each text closed by ``END``; tokens of each text."""
    raw, starts = flat(column)
    raw = _LOWER[raw]
    first, last = word_bounds(raw, starts)
    n_words = np.diff(np.searchsorted(first, starts))
    return np.insert(span_hashes(raw, first, last), np.cumsum(n_words), END), n_words + 1


def _before(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens before each, the farther one first."""
    v, u = np.roll(tokens, 1), np.roll(tokens, 2)
    heads = np.cumsum(sizes) - sizes
    v[heads] = BEGIN
    u[heads] = BEGIN
    u[heads[sizes > 1] + 1] = BEGIN
    return u, v


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        tokens, sizes = _tokens(batch.column("text"))
        words, n = np.unique(_before(tokens, sizes)[1], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])


class Deal:
    """How trigrams are dealt to buckets and written."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, buckets: int):
        """``words``: the most frequent ones of a sample of ``total`` words before another."""
        self.buckets = buckets
        #: Words by number, the most frequent first.
        self.named = np.concatenate([np.zeros(1, np.uint64), words])
        self.slots: np.ndarray | None = None  # made where it is used
        order = np.argsort(words)
        parts = -(-2 * counts[order] * buckets // max(total, 1))  # of half a bucket's tokens at most
        self.split, self.parts = words[order][parts > 1], parts[parts > 1].astype(np.uint64)

    def is_split(self, v: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.split, v), max(len(self.split) - 1, 0))
        return self.split[place] == v if len(self.split) else np.zeros(len(v), bool)

    def bucket(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        salt = np.zeros(len(v), np.uint64)
        if len(self.split):
            place = np.minimum(np.searchsorted(self.split, v), len(self.split) - 1)
            which = np.flatnonzero(self.split[place] == v)
            salt[which] = mixed(w[which] ^ _B) % self.parts[place[which]]
        return (mixed(v ^ END) + salt * _A) % np.uint64(self.buckets)

    def numbers(self, tokens: np.ndarray) -> np.ndarray:
        """The number of each word that has one, from 1; 0 for the others, and for those whose slot a more frequent word has."""
        if self.slots is None:
            self.slots = np.zeros(1 << 22, np.uint32)
            self.slots[self.named[:0:-1] >> np.uint64(42)] = np.arange(len(self.named) - 1, 0, -1)
        number = self.slots[tokens >> np.uint64(42)]
        return np.where(self.named[number] == tokens, number, np.uint32(0))

    def read(self, numbers: np.ndarray, rest: np.ndarray) -> np.ndarray:
        out = self.named[numbers]
        out[numbers == 0] = rest
        return out


def _trigram(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mixed(mixed(mixed((u & _FAR) * _A + v) * _B + w))


class _Run:
    """The distinct trigrams of a run of documents, in the order of their buckets."""

    def __init__(self, held: list[tuple], deal: Deal):
        self.ids = [x for h in held for x in h[6]]
        columns = list(zip(*(h[:6] for h in held), strict=True))
        held.clear()
        w, numbers, u, v, sizes, learned = (np.concatenate(columns.pop(0)) for _ in range(6))
        self.sizes, self.learned = sizes, learned
        keys, bucket = _trigram(u, v, w), deal.bucket(v, w)
        # by bucket, middle word, trigram; cut to fit, so that a trigram may come twice in a bucket
        low = 64 - deal.buckets.bit_length()
        bits = [np.uint64(x) for x in (low, 64 - (low - low // 2), low // 2, 64 - low // 2)]
        place = mixed(v)
        place >>= bits[1]
        place <<= bits[2]
        place |= bucket << bits[0]
        place |= keys >> bits[3]
        order = np.argsort(place, kind="stable")
        del place
        keys = keys[order]
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]])
        del keys
        head = order[fresh]
        self.n = np.add.reduceat(np.repeat(learned, sizes)[order].astype(np.uint32), np.flatnonzero(fresh))
        # the documents of each trigram, how many more than one, and how often it is there
        doc = np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)[order]
        apart = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | fresh[1:]]))
        self.doc, self.often = doc[apart], np.diff(np.append(apart, len(doc))).astype(np.uint32)
        self.docs = (np.diff(np.append(np.flatnonzero(fresh[apart]), len(apart))) - 1).astype(np.uint32)
        del order, doc, fresh, apart
        self.u, self.v, self.w, self.bucket = u[head], v[head], w[head], bucket[head]
        del u, v, w, bucket
        far = np.concatenate([np.zeros(2, np.uint32), numbers])[: len(numbers)]  # of the words two tokens before
        self.number_u, self.number_w = np.where(self.u == BEGIN, np.uint32(0), far[head]), numbers[head]
        self.number_v = np.where(self.v == BEGIN, np.uint32(0), np.roll(numbers, 1)[head])

    def parts(self) -> Iterator[tuple[int, int, bytes]]:
        """``bucket, size, blob``."""
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(self.bucket)) + 1, [len(self.bucket)]])
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            v, nu, nw = self.v[a:b], self.number_u[a:b], self.number_w[a:b]
            heads = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
            nv = self.number_v[a:b][heads]
            blob = press(
                nv=nv, v=v[heads][nv == 0], vn=np.diff(np.append(heads, b - a)).astype(np.uint32), nu=nu, u=self.u[a:b][nu == 0] & _FAR, nw=nw, w=self.w[a:b][nw == 0], n=self.n[a:b],
            )
            yield int(self.bucket[a]), b - a, blob


def _send(batches: Iterator[pa.RecordBatch], deal: Deal) -> Iterator[pa.RecordBatch]:
    """Each run's trigrams to their buckets, and to itself (its number, below zero) where they stand in its documents."""
    number = (TaskContext.get().partitionId() << 20) + 1
    held: list[tuple] = []
    size = 0

    def rows() -> pa.RecordBatch:
        run = _Run(held, deal)
        parts = list(run.parts())
        known = np.array([x is not None for x in run.ids])
        own = press(
            doc=run.doc, often=run.often, docs=run.docs, ids=np.array([x or 0 for x in run.ids], np.int64), known=known.astype(np.uint8), sizes=run.sizes.astype(np.uint32), learned=run.learned.astype(np.uint8),
            bucket=np.array([p[0] for p in parts], np.uint32), pairs=np.array([p[1] for p in parts], np.uint32),
        )
        return pa.RecordBatch.from_arrays(
            [pa.array([*(p[0] for p in parts), -number], pa.int64()), pa.array([number] * (len(parts) + 1), pa.int64()), pa.array([*(p[2] for p in parts), own], pa.binary())], names=["dest", "run", "blob"]
        )

    for batch in slices(batches, "text", SLICE_BYTES):
        tokens, sizes = _tokens(batch.column("text"))
        learned = ~batch.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
        held.append((tokens, deal.numbers(tokens), *_before(tokens, sizes), sizes, learned, batch.column("doc_id").to_pylist()))
        size += len(tokens) * 7
        if size >= RUN_BYTES:
            yield rows()
            number, held, size = number + 1, [], 0
    if held:
        yield rows()


def log_stirling(n: int, discount: float) -> np.ndarray:
    """``[c, t]``: the logarithm of the generalised Stirling number S(c, t)."""
    log = np.full((n + 1, n + 1), -np.inf)
    log[0, 0] = 0.0
    tables = np.arange(n + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(1, n + 1):
            stay = log[c - 1] + np.log(np.maximum(c - 1 - discount * tables, 0))
            log[c, 1:] = np.logaddexp(log[c - 1, :-1], stay[1:])
    return log


_tables: dict[float, np.ndarray] = {}


def _log_table(discount: float) -> np.ndarray:
    if discount not in _tables:
        _tables[discount] = log_stirling(STIRLING, discount)
    return _tables[discount]


class _Level:
    """Dishes of one level: customers and tables, and how many of the latter are likely."""

    def __init__(self, restaurant: np.ndarray, discount: float, strength: float):
        self.restaurant, self.discount, self.strength = restaurant, discount, strength
        self.n = int(restaurant.max()) + 1 if len(restaurant) else 0
        self.log = _log_table(discount)
        self.plain = np.exp(self.log[: DIRECT + 1, : DIRECT + 1])
        self.c = np.zeros(len(restaurant), np.int64)
        self.t = np.zeros(len(restaurant), np.int64)
        #: Customers and tables of each restaurant in other buckets.
        self.other_c, self.other_t = np.zeros(self.n), np.zeros(self.n)
        self.turn = (np.arange(len(restaurant)) % TURNS).astype(np.uint8)  # dishes stand in the order of their hashes

    def seat(self, customers: np.ndarray) -> None:
        """Set the number of customers; tables stay as far as they can."""
        self.t = np.where(self.c == 0, np.ceil(customers**0.5).astype(np.int64), self.t)
        self.c = customers
        self.t = np.clip(self.t, np.minimum(self.c, 1), self.c)

    def own(self) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables of each restaurant, as far as this bucket's dishes go."""
        return tuple(np.bincount(self.restaurant, weights=x, minlength=self.n) for x in (self.c, self.t))

    def totals(self) -> tuple[np.ndarray, np.ndarray]:
        c, t = self.own()
        return c + self.other_c, t + self.other_t

    def probability(self, parent: np.ndarray) -> np.ndarray:
        """Of each dish in its restaurant; ``parent``: in the one above."""
        c, t = self.totals()
        r = self.restaurant
        return (self.c - self.discount * self.t + (self.strength + self.discount * t[r]) * parent) / (self.strength + c[r])

    def limit(self, c: np.ndarray, t: np.ndarray) -> np.ndarray:
        """What the chance that one of ``c`` customers at ``t`` tables sits alone tends to."""
        x = (t - 1) / np.maximum(c - 1, 1)
        return self.discount * x / (1 - (1 - self.discount) * x)

    def sweep(self, parent: np.ndarray, rng: np.random.Generator, moving: np.ndarray | None = None) -> None:
        """Seat customers anew; ``parent``: the probability of a dish's next customer there, without those this dish sends; ``moving``: dishes that may."""
        several = np.flatnonzero(self.c > 1 if moving is None else (self.c > 1) & moving)
        _, tables = self.totals()
        for turn in range(TURNS):
            which = several[self.turn[several] == turn]
            if not len(which):
                continue
            before = self.t[which]
            # the j-th new table weighs (strength + discount * (tables of other dishes + j)) * parent
            base = self.strength + self.discount * (tables[self.restaurant[which]] - self.t[which])
            c, share = self.c[which], parent[which]
            least = 2
            while least <= STIRLING:  # dishes of 2, 3 or 4, 5 to 8, ... customers at a time
                most = 2 if least == 2 else 2 * (least - 1)
                who = np.flatnonzero((c >= least) & (c <= most))
                for some in np.array_split(who, len(who) * most // BLOCK + 1):
                    if len(some) and most <= DIRECT:  # by how much each table more is likelier than the first
                        weights = self.plain[c[some], 1 : most + 1]
                        weights[:, 1:] *= np.cumprod((base[some][:, None] + self.discount * np.arange(1, most)) * share[some][:, None], axis=1)
                        self.t[which[some]] = 1 + _picked(np.cumsum(weights, axis=1), rng)
                    elif len(some):
                        new = np.cumsum(np.log(base[some][:, None] + self.discount * np.arange(most)) + np.log(share[some])[:, None], axis=1)
                        self.t[which[some]] = 1 + _drawn(self.log[c[some], 1 : most + 1] + new, rng)
                least = most + 1
            who = np.flatnonzero(c > STIRLING)
            for some in np.array_split(who, len(who) * GRID // BLOCK + 1):
                if len(some):
                    self.t[which[some]] = self._far(c[some], base[some], share[some], rng)
            np.add.at(tables, self.restaurant[which], (self.t[which] - before).astype(np.float64))

    def _far(self, c: np.ndarray, base: np.ndarray, share: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Numbers of tables of dishes with many customers, from a grid about the likeliest number."""

        def step(c: np.ndarray, t: np.ndarray, base: np.ndarray, share: np.ndarray) -> np.ndarray:
            """By how much the logarithm of the weight grows from ``t`` to ``t + 1`` tables."""
            with np.errstate(divide="ignore"):
                return np.log(base + self.discount * t) + np.log(share) + np.log(np.maximum(1 - self.limit(c, t), 0)) - np.log(self.limit(c, t + 1)) - np.log(c - 1 - self.discount * t)

        low, high = np.ones(len(c), np.int64), c.copy()
        while (low < high).any():
            middle = (low + high) // 2
            up = (step(c, middle, base, share) > 0) & (middle < high)
            low, high = np.where(up, middle + 1, low), np.where(up, high, middle)
        near = np.clip(low, 1, c - 2)
        wide = np.sqrt(1 / np.maximum(step(c, near, base, share) - step(c, near + 1, base, share), 1e-12))
        stride = np.maximum(1, np.ceil(np.minimum(12 * wide + 64, c) / GRID)).astype(np.int64)[:, None]
        t = np.maximum(low[:, None] - stride * (GRID // 2), 1) + stride * np.arange(GRID)
        inside = t <= c[:, None]
        grown = stride * step(c[:, None], np.clip(t + (stride - 1) / 2, 1, c[:, None] - 1), base[:, None], share[:, None])
        log = np.concatenate([np.zeros((len(c), 1)), np.cumsum(grown[:, :-1], axis=1)], axis=1)
        at = _drawn(np.where(inside, log, -np.inf), rng)
        stride = stride[:, 0]
        return np.clip(t[np.arange(len(c)), at] + (rng.random(len(c)) * stride).astype(np.int64) - (stride - 1) // 2, 1, c)


def _drawn(log: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A column for each row, by the rows' logarithmic weights."""
    return _picked(np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1), rng)


def _picked(weights: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A column for each row, by the rows' weights, given as running sums."""
    return np.minimum((weights < (1 - rng.random(len(weights)))[:, None] * weights[:, -1:]).sum(axis=1), weights.shape[1] - 1)


class _Beside:
    """Seats of a bucket's open restaurants alone, in another sample than the bucket's own; what does not differ between samples is shared."""

    def __init__(self, pair_of: np.ndarray, v_of: np.ndarray, dish: np.ndarray, word: np.ndarray, counts: np.ndarray):
        self.pair, self.bigram, self.dish, self.word = _Level(pair_of, *PAIR), _Level(v_of, *WORD), dish, word
        self.pair.seat(counts)
        self.climb()

    def climb(self) -> None:
        self.bigram.seat(np.bincount(self.dish, weights=self.pair.t, minlength=len(self.bigram.c)).astype(np.int64))

    def sweep(self, root: np.ndarray, rng: np.random.Generator) -> None:
        """Seat trigrams, then bigrams; ``root``: the probabilities of the bucket's words there."""
        parent = root[self.word]
        self.pair.sweep(_without(self.bigram, self.pair, self.dish, parent), rng)
        self.climb()
        self.bigram.sweep(parent, rng)

    def predict(self, root: np.ndarray) -> np.ndarray:
        return self.pair.probability(self.bigram.probability(root[self.word])[self.dish])


def _without(level: _Level, below: _Level, dish: np.ndarray, parent: np.ndarray) -> np.ndarray:
    """For each dish ``below`` with several customers: the probability at ``level`` of a customer more, if its own ones (to the ``dish`` there) were not there; others need none."""
    c, t = level.totals()
    which = np.flatnonzero(below.c > 1)
    of, sent = dish[which], below.t[which]
    r = level.restaurant[of]
    left = level.c[of] - sent
    tables = np.where(left > 0, np.minimum(level.t[of], left), 0)
    gone = level.t[of] - tables
    out = np.zeros(len(below.c))
    out[which] = (left - level.discount * tables + (level.strength + level.discount * (t[r] - gone)) * parent[of]) / (level.strength + c[r] - sent)
    return out


def _order(keys: np.ndarray) -> np.ndarray:
    """What sorts hashes: their higher bits with their places below them, if these bits tell them apart, as they mostly do; numbers sort faster than places."""
    low = np.uint64((1 << max(len(keys) - 1, 0).bit_length()) - 1)
    both = keys & ~low
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()
    order = (both & low).astype(np.int64)
    ordered = keys[order]
    return order if (ordered[1:] >= ordered[:-1]).all() else np.argsort(keys)


def _unique(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, where the first of each stands, and the number of each key's."""
    order = _order(keys)
    ordered = keys[order]
    fresh = np.concatenate([[True], ordered[1:] != ordered[:-1]]) if len(keys) else np.zeros(0, bool)
    of = np.empty(len(keys), np.int32)
    of[order] = np.cumsum(fresh, dtype=np.int32) - 1
    return ordered[fresh], order[fresh], of


class Bucket:
    """The seating of the restaurants of a bucket's words and of their pairs."""

    def __init__(self, columns: list[np.ndarray], deal: Deal, seed: int):
        """``columns``: ``u, v, w, n`` of trigrams, which are taken out of the list so that they can be let go."""
        u, v, w, n = (columns.pop(0) for _ in range(4))
        self.rng = np.random.default_rng([SEED, seed])
        self.trigrams, first, self.request = _unique(_trigram(u, v, w))
        u, v, w = u[first], v[first], w[first]
        counts = np.bincount(self.request, weights=n, minlength=len(first)).astype(np.int64)
        del n, first
        pair_key, pair_at, pair = _unique(mixed((u & _FAR) * _A + v))
        _, dish_at, self.dish = _unique(mixed(v * _B + w))
        dish_v, dish_w = v[dish_at], w[dish_at]
        self.v_key, _, own_v = _unique(dish_v)
        self.words, _, self.word = _unique(dish_w)
        #: Trigrams in the restaurants of pairs; bigrams in those of words; words in a root.
        self.pair, self.bigram, self.root = _Level(pair, *PAIR), _Level(own_v, *WORD), _Level(np.zeros(len(self.words), np.int64), *ROOT)
        #: How often each word was learned, as far as the bucket's trigrams go; later, by all of them.
        self.own_tokens = self.tokens = np.bincount(self.word[self.dish], weights=counts, minlength=len(self.words)).astype(np.int64)
        # restaurants that other buckets have dishes of, by key: pairs, then words
        self.open_pair, self.open_v = np.flatnonzero(deal.is_split(v[pair_at])), np.flatnonzero(deal.is_split(self.v_key))
        keys = np.concatenate([pair_key[self.open_pair], mixed(self.v_key[self.open_v])])
        self.open_order = np.argsort(keys)
        self.open_keys = keys[self.open_order]
        closed_v = np.ones(len(self.v_key), bool)
        closed_v[self.open_v] = False
        self.closed_bigram = closed_v[own_v]
        self.closed_trigram = self.closed_bigram[self.dish]
        self.vocabulary = int((self.tokens > 0).sum())
        self.shared = False
        self.pair.seat(counts)
        self._climb()
        #: The open restaurants in the samples after the first, whose seats are the bucket's own.
        self.beside: list[_Beside] = []
        self.open_trigram, open_bigram = np.flatnonzero(~self.closed_trigram), np.flatnonzero(~self.closed_bigram)
        if len(self.open_trigram):
            of = np.searchsorted(self.open_pair, pair[self.open_trigram]), np.searchsorted(self.open_v, own_v[open_bigram]), np.searchsorted(open_bigram, self.dish[self.open_trigram])
            of += self.word[open_bigram], counts[self.open_trigram]
            self.beside = [_Beside(*of) for _ in range(SAMPLES - 1)]

    def _climb(self) -> None:
        """A level's tables are the customers of the next."""
        self.bigram.seat(np.bincount(self.dish, weights=self.pair.t, minlength=len(self.bigram.c)).astype(np.int64))
        if not self.shared:
            self.root.seat(self.root_customers())

    def root_customers(self) -> np.ndarray:
        return np.bincount(self.word, weights=self.bigram.t, minlength=len(self.words)).astype(np.int64)

    def _base(self) -> np.ndarray:
        return np.full(len(self.words), 1 / (self.vocabulary + 1))

    def sweep(self, all_seats: bool = True) -> None:
        """Seat trigrams, then bigrams, then words (these only while the root is the bucket's own); ``all_seats``: in open restaurants too."""
        root = self.root.probability(self._base())[self.word]
        moving = None if all_seats else self.closed_trigram
        self.pair.sweep(_without(self.bigram, self.pair, self.dish, root), self.rng, moving)
        self._climb()
        if self.shared:  # the root's seats are those of the round's sums
            parent = root
        else:
            parent = _without(self.root, self.bigram, self.word, self._base())
        self.bigram.sweep(parent, self.rng, None if all_seats else self.closed_bigram)
        self._climb()
        if not self.shared:
            self.root.sweep(self._base(), self.rng)
        if all_seats and self.beside:
            root = self.root.probability(self._base())
            for other in self.beside:
                other.sweep(root, self.rng)

    def sums(self) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
        """``key, customers, tokens`` of the root's dishes, and ``key, customers, tables`` of other open restaurants, of the latter two a row for each sample."""
        c, t = (np.zeros((SAMPLES, len(self.open_keys)), np.int64) for _ in range(2))
        if len(self.open_keys):
            own = [([x[self.open_pair] for x in self.pair.own()], [x[self.open_v] for x in self.bigram.own()]), *((b.pair.own(), b.bigram.own()) for b in self.beside)]
            for i, (of_pair, of_v) in enumerate(own):
                c[i], t[i] = (np.concatenate([p, v])[self.open_order] for p, v in zip(of_pair, of_v, strict=True))
        return (self.words, self.root_customers(), self.own_tokens), (self.open_keys, c, t)

    def learn(self, c: np.ndarray, t: np.ndarray, tokens: np.ndarray, open_c: np.ndarray, open_t: np.ndarray, totals: np.ndarray, tables: np.ndarray) -> None:
        """Take what ``sums`` add up to over all buckets; ``t``: tables of the root's dishes, a row for each of its seatings; ``totals``: customers of the root, its dishes, all tokens; ``tables``: the root's, in each seating."""
        _, (_, own_c, own_t) = self.sums()
        other_c, other_t = np.zeros(open_c.shape), np.zeros(open_t.shape)
        other_c[:, self.open_order], other_t[:, self.open_order] = open_c - own_c, open_t - own_t
        n = len(self.open_pair)
        for level, which, cut in ((self.pair, self.open_pair, slice(0, n)), (self.bigram, self.open_v, slice(n, None))):
            level.other_c[which], level.other_t[which] = other_c[0, cut], other_t[0, cut]
        for i, other in enumerate(self.beside, 1):
            other.pair.other_c, other.pair.other_t, other.bigram.other_c, other.bigram.other_t = other_c[i, :n], other_t[i, :n], other_c[i, n:], other_t[i, n:]
        self.shared = True
        self.root.c, self.root.other_c = c, np.array([totals[0] - c.sum()])
        self.root_t, self.root_tables = t, tables
        self._seat_root(0)
        self.vocabulary, self.total, self.tokens = int(totals[1]), int(totals[2]), tokens

    def _seat_root(self, number: int) -> None:
        self.root.t = self.root_t[number]
        self.root.other_t = np.array([self.root_tables[number] - self.root.t.sum()])

    def state(self) -> dict[str, np.ndarray]:
        """Tables of dishes with several customers (others have one a customer), of all samples, and where the random numbers stand."""
        at = self.rng.bit_generator.state["state"]["state"]
        seats = {f"{name}_t": np.concatenate([level.t[level.c > 1] for level in (getattr(x, name) for x in (self, *self.beside))]).astype(np.uint64) for name in ("pair", "bigram")}
        return {**seats, "rng": np.array([at >> 64, at & ((1 << 64) - 1)], np.uint64)}

    def resume(self, pair_t: np.ndarray, bigram_t: np.ndarray, rng: np.ndarray) -> None:
        """Seat a new bucket as ``state`` left it; the root's seats are to be learned."""
        self.shared = True
        at = above = 0
        for x, climb in ((self, self._climb), *((b, b.climb) for b in self.beside)):
            several = np.flatnonzero(x.pair.c > 1)
            x.pair.t[several] = pair_t[at : at + len(several)]
            at += len(several)
            climb()
            several = np.flatnonzero(x.bigram.c > 1)
            x.bigram.t[several] = bigram_t[above : above + len(several)]
            above += len(several)
        stream = self.rng.bit_generator.state
        stream["state"]["state"] = int(rng[0]) << 64 | int(rng[1])
        self.rng.bit_generator.state = stream

    def predict(self) -> np.ndarray:
        """The probability of each distinct trigram, as seated now."""
        root = self.root.probability(self._base()) if len(self.words) else np.zeros(0)
        return self.pair.probability(self.bigram.probability(root[self.word])[self.dish])

    def sampled(self) -> np.ndarray:
        """The mean over samples after the last round's sums.  Each has seats of its own: of the root as its owners drew them, of open restaurants as the rounds left them, with the totals of these, of others as they are swept here."""
        mean = self.predict()
        for number in range(1, SAMPLES):
            self._seat_root(number)
            self.sweep(all_seats=False)
            one = self.predict()
            if self.beside:
                one[self.open_trigram] = self.beside[number - 1].predict(self.root.probability(self._base()))
            mean += one
        return mean / SAMPLES


def _owners(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (mixed(keys ^ _A) % np.uint64(buckets)).astype(np.int64)


def _dealt(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each owner the places of its keys; every owner has some, or none."""
    owner = _owners(keys, buckets)
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(buckets + 1))
    for k in range(buckets):
        yield k, order[cuts[k] : cuts[k + 1]]


def seated(table: pa.Table, told: pa.Table | None, deal: Deal) -> tuple[list[tuple[int, int]], Bucket]:
    """``run, trigrams`` of each blob, and the bucket after the last round in ``told``, which brings back how it was seated before; the same whenever and in whatever order blobs arrive."""
    rows = sorted(zip(table.column("run").to_pylist(), table.column("blob").to_pylist(), strict=True), key=lambda r: r[0])
    opened = (unpress(b) for _, b in rows)
    parts = [(deal.read(o["nu"], o["u"]), np.repeat(deal.read(o["nv"], o["v"]), o["vn"]), deal.read(o["nw"], o["w"]), o["n"]) for o in opened]
    heads = [(run, len(x[3])) for (run, _), x in zip(rows, parts, strict=True)]
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    del parts, rows
    bucket = Bucket(columns, deal, table.column("dest")[0].as_py())
    if told is None:
        for _ in range(BURN_IN):
            bucket.sweep()
        return heads, bucket
    answers = told.sort_by([("round", "ascending"), ("owner", "ascending")]).to_pylist()
    last = answers[-1]["round"]
    got = [unpress(a["blob"]) for a in answers if a["round"] == last]
    bucket.resume(*(got[table.column("dest")[0].as_py()][name] for name in _STATE))
    seatings = len(got[0]["tables"])
    out = [np.zeros((n, len(bucket.words)), np.int64) for n in (1, seatings, 1)] + [np.zeros((SAMPLES, len(bucket.open_keys)), np.int64) for _ in range(2)]
    for keys, names, values in ((bucket.words, ("c", "t", "tokens"), out[:3]), (bucket.open_keys, ("open_c", "open_t"), out[3:])):
        for k, places in _dealt(keys, deal.buckets):
            for name, value in zip(names, values, strict=True):
                value[:, places] = got[k][name].reshape(len(value), -1)
    c, t, tokens, open_c, open_t = out
    bucket.learn(c[0], t, tokens[0], open_c, open_t, *(sum((g[name] for g in got), np.zeros(n)) for name, n in (("totals", 3), ("tables", seatings))))
    if last < ROUNDS - 1:
        bucket.sweep()
    return heads, bucket


#: What a bucket has its own owner send back, so that no sweep is done twice.
_STATE = ("pair_t", "bigram_t", "rng")
_ASKED = {"owner": pa.int32(), "dest": pa.int64(), "blob": pa.binary()}
_TOLD = {"dest": pa.int64(), "round": pa.int32(), "owner": pa.int32(), "blob": pa.binary()}
_ANSWERS = {"dest": pa.int64(), "bucket": pa.int32(), "blob": pa.binary()}
_SCORES = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64(), "train_tokens": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}


def _table(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())], names=list(kinds))


def ask(table: pa.Table, told: pa.Table | None, deal: Deal) -> pa.Table:
    """What a bucket adds to open restaurants, to their owners; in the first round with the keys, which stay the same."""
    if not table.num_rows or table.column("dest")[0].as_py() < 0:
        return _table([], _ASKED)
    _, bucket = seated(table, told, deal)
    (words, c, tokens), (keys, open_c, open_t) = bucket.sums()
    dest = table.column("dest")[0].as_py()
    rows = []
    for (k, of_root), (_, of_open) in zip(_dealt(words, deal.buckets), _dealt(keys, deal.buckets), strict=True):
        named = {"key": words[of_root], "tokens": tokens[of_root].astype(np.uint64), "keys": keys[of_open]} if told is None else {}
        kept = bucket.state() if k == dest else {}
        blob = press(**named, **kept, c=c[of_root].astype(np.uint64), open_c=open_c[:, of_open].ravel().astype(np.uint64), open_t=open_t[:, of_open].ravel().astype(np.uint64))
        rows.append((k, dest, blob))
    return _table(rows, _ASKED)


def tell(table: pa.Table, first: pa.Table, number: int, deal: Deal) -> pa.Table:
    """The owner's part of a round: sums, seats at the root, and to each bucket what it asked for; ``first``: what it asked in the first round."""
    if not table.num_rows:
        return _table([], _TOLD)
    owner = table.column("owner")[0].as_py()
    rows: dict[int, dict[str, np.ndarray]] = {}
    for t in (first, table):
        for dest, blob in zip(t.column("dest").to_pylist(), t.column("blob").to_pylist(), strict=True):
            rows[dest] = rows.get(dest, {}) | unpress(blob)
    asking = sorted(rows.items())
    opened = [o for _, o in asking]

    def summed(key: str, names: tuple[str, str], samples: int) -> tuple[list[np.ndarray], np.ndarray]:
        """Sums by key, a row for each sample, and where each key is among them."""
        distinct, _, of = _unique(np.concatenate([o[key] for o in opened]))
        rows = ([np.concatenate(x) for x in zip(*(o[n].reshape(samples, -1) for o in opened), strict=True)] for n in names)
        return [np.stack([np.bincount(of, weights=x, minlength=len(distinct)).astype(np.int64) for x in some]) for some in rows], of

    ((c,), (tokens,)), of_root = summed("key", ("c", "tokens"), 1)
    (open_c, open_t), of_open = summed("keys", ("open_c", "open_t"), SAMPLES)
    level = _Level(np.zeros(len(c), np.int64), *ROOT)
    level.seat(c)
    rng = np.random.default_rng([SEED, number, owner])
    vocabulary = int((tokens > 0).sum()) * deal.buckets
    seatings = []
    for turn in range(BURN_IN + (SAMPLES - 1 if number == ROUNDS - 1 else 0)):  # owners have equal parts of the root, but for chance
        if len(c):
            level.other_t = np.array([level.t.sum() * (deal.buckets - 1.0)])
            level.sweep(np.full(len(c), 1 / (vocabulary + 1)), rng)
        if turn >= BURN_IN - 1:
            seatings.append(level.t.copy())
    seated_t = np.stack(seatings)
    totals, tables = np.array([c.sum(), (tokens > 0).sum(), tokens.sum()], np.float64), seated_t.sum(axis=1).astype(np.float64)
    out, at, open_at = [], 0, 0
    for dest, o in asking:
        mine, mine_open = of_root[at : at + len(o["key"])], of_open[open_at : open_at + len(o["keys"])]
        at, open_at = at + len(mine), open_at + len(mine_open)
        kept = {name: o[name] for name in _STATE if dest == owner}
        of_open_keys = {"open_c": open_c[:, mine_open].ravel().astype(np.uint64), "open_t": open_t[:, mine_open].ravel().astype(np.uint64)}
        blob = press(**kept, **of_open_keys, c=c[mine].astype(np.uint64), t=seated_t[:, mine].ravel().astype(np.uint64), tokens=tokens[mine].astype(np.uint64), totals=totals, tables=tables)
        out.append((dest, number, owner, blob))
    return _table(out, _TOLD)


def answer(table: pa.Table, told: pa.Table, deal: Deal) -> pa.Table:
    """For each run, the log10 probability of each of its trigrams that are of this bucket, and the count of its last word."""
    if not table.num_rows or table.column("dest")[0].as_py() < 0:
        return _table([], _ANSWERS)
    heads, bucket = seated(table, told, deal)
    score = np.round(np.log10(bucket.sampled()) * -FINE).astype(np.uint32)
    counts = bucket.tokens[bucket.word[bucket.dish]].astype(np.uint64)
    rows, at = [], 0
    for run, n in heads:
        which = bucket.request[at : at + n]
        at += n
        rows.append((-run, table.column("dest")[0].as_py(), press(score=score[which], count=counts[which], total=np.array([bucket.total, bucket.vocabulary], np.int64))))
    return _table(rows, _ANSWERS)


def _summed(runs: pa.Table, answers: pa.Table) -> pa.Table:
    if not runs.num_rows or runs.column("dest")[0].as_py() >= 0:
        return _table([], _SCORES)
    got = {b: blob for b, blob in zip(answers.column("bucket").to_pylist(), answers.column("blob").to_pylist(), strict=True)}
    (blob,) = runs.column("blob").to_pylist()
    run = unpress(blob)
    parts = [unpress(got[b]) for b in run["bucket"].tolist()]
    if [len(p["score"]) for p in parts] != run["pairs"].tolist():
        raise ValueError("the documents were not the same when read again")
    total, vocabulary = parts[0]["total"].tolist()
    score = np.concatenate([p["score"] for p in parts]) / -FINE
    count = np.concatenate([p["count"] for p in parts]).astype(np.float64)
    base = np.log10((count + 1) / (total + vocabulary + 1))
    of = np.repeat(np.arange(len(score)), run["docs"].astype(np.int64) + 1)
    known, base, score = (np.bincount(run["doc"], weights=x[of] * run["often"], minlength=len(run["sizes"])) for x in (count > 0, base, score))
    known = known.astype(np.int64)
    ids = [i if k else None for i, k in zip(run["ids"].tolist(), run["known"].tolist(), strict=True)]
    columns = (ids, run["learned"] == 0, run["sizes"].astype(np.int64), known, np.full(len(ids), total, np.int64), base, score)
    return pa.table([pa.array(c, kind) for c, kind in zip(columns, _SCORES.values(), strict=True)], names=list(_SCORES))


def dealing(narrow: DataFrame) -> Deal:
    """Buckets by the size of the input; frequent words by a sample of texts."""
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = bucket_count(size, TASK_BYTES)
    some = narrow.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, size // SAMPLE_BYTES))) == 0)
    counted = some.select("text").mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialise(counted, "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    top = words.orderBy(F.desc("n"), "word").limit(NUMBERED).toPandas()
    return Deal(top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64), total, buckets)


def lm_scores(docs: DataFrame) -> DataFrame:
    r"""``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each row of ``docs`` (``doc_id``, ``text``).

    Tokens are the words ``[^\x20\x09-\x0D]+``, A-Z in lower case, and one end.
    The model learns from the rows that are not ``held_out``.  ``base_score``: of
    an add-one unigram model; ``score``: log10 probability of the text;
    perplexity is 10 ** (-score / n_tokens).

    Null, empty and blank texts are their end token.  Null ids are learned from.
    Repeated rows count, and are scored, row by row; other columns are not read.
    With nothing to learn from every token is sure (score 0).  An empty table
    gives an empty table.  A text is tokenised in one piece, with some 50 bytes
    of memory a byte.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    deal = dealing(narrow)
    sent = narrow.mapInArrow(lambda b: _send(b, deal), "dest long, run long, blob binary")
    question, reply = "owner int, dest long, blob binary", "dest long, round int, owner int, blob binary"

    def owners_part(number: int):
        return lambda t, first: tell(t, first, number, deal)

    first = sent.groupBy("dest").applyInArrow(lambda t: ask(t, None, deal), question)
    told = first.groupBy("owner").applyInArrow(lambda t: tell(t, t, 0, deal), reply)
    for number in range(1, ROUNDS):
        asked = sent.groupBy("dest").cogroup(told.groupBy("dest")).applyInArrow(lambda t, k: ask(t, k, deal), question)
        told = asked.groupBy("owner").cogroup(first.groupBy("owner")).applyInArrow(owners_part(number), reply)
    answers = sent.groupBy("dest").cogroup(told.groupBy("dest")).applyInArrow(lambda t, k: answer(t, k, deal), "dest long, bucket int, blob binary")
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return sent.groupBy("dest").cogroup(answers.groupBy("dest")).applyInArrow(_summed, result)


def query(spark, sf_dir: str) -> DataFrame:
    return lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
