import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from ferrule.llm import pitman_yor as p


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def is_held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def brute_base(rows):
    counts = Counter(w for i, t in rows if not is_held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return sorted(((i, is_held(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for i, t in rows), key=repr)


def base(df):
    return sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in df), key=repr)


def test_documents(documents, rows, small_tasks):
    out = p.lm_scores(documents).collect()
    assert base(out) == brute_base(rows)
    held = [r for r in out if r["held_out"]]
    bits = lambda k: -sum(r[k] for r in held) / sum(r["n_tokens"] for r in held)
    assert bits("score") < bits("base_score")  # held-out perplexity beats the unigram's
    assert all(r["score"] < 0 for r in out)


def test_same_again(documents, small_tasks):
    one, two = ({r["doc_id"]: r["score"] for r in p.lm_scores(documents).collect()} for _ in range(2))
    assert one == two


def test_awkward(awkward, empty, small_tasks):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    out = p.lm_scores(awkward).collect()
    assert base(out) == brute_base(rows)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in out)
    assert p.lm_scores(empty).count() == 0


def test_nothing_to_learn_from(spark):
    i = next(i for i in range(100) if is_held(i))
    (row,) = p.lm_scores(spark.createDataFrame([(i, "a b a")], "doc_id long, text string")).collect()
    assert (row["train_tokens"], row["n_known"], row["base_score"], row["score"]) == (0, 0, 0.0, 0.0)


def by(tables, column):
    """Rows of tables by the value of a column, as a shuffle would bring them."""
    import pyarrow as pa

    whole = pa.concat_tables([t for t in tables if t.num_rows])
    return {k: whole.filter(pa.compute.equal(whole.column(column), k)) for k in set(whole.column(column).to_pylist())}


def exchanged(texts, buckets, monkeypatch):
    """The real rounds over ``texts`` (those with an odd place held out), without Spark: buckets, with u, v, w of each trigram, and the deal."""
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    monkeypatch.setattr(p, "RUN_BYTES", 3000)
    monkeypatch.setattr(p, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": staticmethod(lambda: 3)}))}))
    batch = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts), "held_out": pa.array([i % 2 == 1 for i in range(len(texts))])})
    counted = Counter()
    for x in p._count_words(iter([batch])):
        counted.update(dict(zip(x.column("word").to_numpy().view(np.uint64).tolist(), x.column("n").to_pylist())))
    common = counted.most_common(30)
    deal = p.Deal(np.array([w for w, _ in common], np.uint64), np.array([n for _, n in common]), sum(counted.values()), buckets)
    sent = by([pa.Table.from_batches([b]) for b in p._send(iter([batch.slice(i, 1) for i in range(len(texts))]), deal)], "dest")
    told = {}
    for number in range(p.ROUNDS):
        asked = by([p.ask(t, told.get(k), deal) for k, t in sent.items()], "owner")
        first = asked if number == 0 else first
        more = by([p.tell(t, first[k], number, deal) for k, t in asked.items()], "dest")
        told = {k: pa.concat_tables([told[k], t]) if k in told else t for k, t in more.items()}
    return {k: p.seated(t, told[k], deal)[1] for k, t in sent.items() if k >= 0}, deal, sent, told


def corpus(n=3000, words=60, seed=5):
    rng = np.random.default_rng(seed)
    tokens = [f"w{x}" for x in rng.zipf(1.3, n) % words]
    return [" ".join(tokens[i : i + 25]) for i in range(0, n, 25)]


def test_probabilities_sum_to_one(monkeypatch):
    """Over all words and an unknown one, in restaurants of every kind, after the rounds as they run."""
    learned = corpus()
    vocabulary = sorted({w for t in learned for w in t.split()})
    pairs = [("w1", "w1"), ("w1", "w7"), ("w7", "w1"), ("never", "w1"), ("w1", "never"), (vocabulary[-1], vocabulary[-2])]
    # held-out texts ask for every word after each pair
    asked = [" ".join(f"{u} {v} {w}" for w in [*vocabulary, "unknown"]) for u, v in pairs] + [f"{u} {v}" for u, v in pairs]
    texts = [x for pair in zip(learned + [""] * 50, asked + ["w1"] * 200) for x in pair]
    buckets, deal, *_ = exchanged(texts, 25, monkeypatch)
    assert len(deal.split) >= 2
    names = {w: int(p._tokens(__import__("pyarrow").array([w]))[0][0]) for w in [*vocabulary, "unknown", "never"]}
    got = {}
    for b in buckets.values():
        got |= dict(zip(b.trigrams.tolist(), b.sampled().tolist()))
    for u, v in pairs:
        keys = [int(p._trigram(*(np.array([x], np.uint64) for x in (names[u], names[v], w)))[0]) for w in [*(names[w] for w in [*vocabulary, "unknown"]), int(p.END)]]
        assert sum(got[k] for k in keys) == pytest.approx(1, abs=1e-9)


def test_rounds_agree(monkeypatch):
    """Totals that buckets were told are those of the seats they told of; the root's dishes are seated."""
    buckets, deal, *_ = exchanged(corpus(), 5, monkeypatch)
    known = Counter()
    for b in buckets.values():
        assert ((b.pair.t >= (b.pair.c > 0)) & (b.pair.t <= b.pair.c)).all() and ((b.bigram.t >= (b.bigram.c > 0)) & (b.bigram.t <= b.bigram.c)).all()
        assert b.bigram.c.sum() == b.pair.t.sum()
        for w, c in zip(b.words.tolist(), b.root_customers().tolist()):
            known[w] += c
    for b in buckets.values():  # no seat has moved since the last sums
        assert b.root.c.tolist() == [known[w] for w in b.words.tolist()]
        assert b.root.totals()[0][0] == sum(known.values())
        c, t = b.bigram.totals()
        for k in b.open_v.tolist():
            v = int(b.v_key[k])
            own = [(x.bigram.c[x.bigram.restaurant == i].sum(), x.bigram.t[x.bigram.restaurant == i].sum()) for x in buckets.values() for i in np.flatnonzero(x.v_key == v)]
            assert (c[k], t[k]) == tuple(map(sum, zip(*own)))


def test_order_of_arrival_does_not_matter(monkeypatch):
    _, deal, sent, told = exchanged(corpus(1500), 4, monkeypatch)
    for k, t in sent.items():
        if k >= 0:
            back = list(range(t.num_rows))[::-1], list(range(told[k].num_rows))[::-1]
            one, two = p.answer(t, told[k], deal), p.answer(t.take(back[0]), told[k].take(back[1]), deal)
            assert one.equals(two)


def test_gibbs_has_the_right_distribution():
    """Tables of two dishes of one restaurant, of 6 and 3 customers, against their exact joint distribution."""
    d, s, parent, c = 0.5, 2.0, (0.3, 0.05), (6, 3)
    stirling = np.zeros((7, 7))
    stirling[0, 0] = 1
    for n in range(1, 7):
        for t in range(1, n + 1):
            stirling[n, t] = stirling[n - 1, t - 1] + (n - 1 - d * t) * stirling[n - 1, t]
    weights = np.array([[stirling[6, a] * stirling[3, b] * parent[0] ** a * parent[1] ** b * np.prod([s + d * j for j in range(a + b)]) for b in range(1, 4)] for a in range(1, 7)])
    n = 6000
    level = p._Level(np.repeat(np.arange(n), 2), d, s)
    level.turn = np.tile([0, 1], n)
    level.seat(np.tile(c, n))
    rng = np.random.default_rng(0)
    for _ in range(25):
        level.sweep(np.tile(parent, n), rng)
    share = np.zeros((6, 3))
    np.add.at(share, (level.t[::2] - 1, level.t[1::2] - 1), 1 / n)
    assert np.abs(share - weights / weights.sum()).max() < 0.025


def test_against_customers_seated_one_by_one(monkeypatch):
    """Mean predictive probabilities on a tiny corpus, against a sampler that reseats single customers at explicit tables."""
    import random

    texts = [x for t in corpus(260, 6, 3) for x in (t, "")]
    monkeypatch.setattr(p, "SAMPLES", 400)
    (bucket,) = exchanged(texts, 1, monkeypatch)[0].values()
    bucket.shared = False  # one bucket: its own root is the root
    bucket.root.other_c[:], bucket.root.other_t[:] = 0, 0
    mean = np.zeros(len(bucket.trigrams))
    for _ in range(400):
        bucket.sweep()
        mean += bucket.predict() / 400

    rng = random.Random(1)
    base = 1 / (bucket.vocabulary + 1)
    levels = (p.ROOT, p.WORD, p.PAIR)
    seats = {}  # context -> dish -> customers of each table

    def prob(context, w):
        if context is None:
            return base
        d, s = levels[len(context)]
        here = seats.get(context, {})
        c, t = sum(map(sum, here.values())), sum(map(len, here.values()))
        return (sum(here.get(w, ())) - d * len(here.get(w, ())) + (s + d * t) * prob(up(context), w)) / (s + c)

    def up(context):
        return context[1:] if context else None

    def add(context, w):
        if context is None:
            return
        d, s = levels[len(context)]
        here = seats.setdefault(context, {}).setdefault(w, [])
        t = sum(map(len, seats[context].values()))
        weights = [x - d for x in here] + [(s + d * t) * prob(up(context), w)]
        k = rng.choices(range(len(weights)), weights)[0]
        if k < len(here):
            here[k] += 1
        else:
            here.append(1)
            add(up(context), w)

    def remove(context, w):
        if context is None:
            return
        here = seats[context][w]
        k = rng.choices(range(len(here)), here)[0]
        here[k] -= 1
        if not here[k]:
            del here[k]
            remove(up(context), w)

    tokens = [(("<", "<") + tuple(t.split()))[i : i + 2] + ((*t.split(), ">")[i],) for t in texts[::2] for i in range(len(t.split()) + 1)]
    for u, v, w in tokens:
        add((u, v), w)
    expected = Counter()
    for sweep in range(500):
        for u, v, w in tokens:
            remove((u, v), w)
            add((u, v), w)
        if sweep >= 100:
            for x in set(tokens):
                expected[x] += prob(x[:2], x[2]) / 400
    import pyarrow as pa

    code = {w: int(p._tokens(pa.array([w]))[0][0]) for w in {x for t in tokens for x in t} - {"<", ">"}} | {"<": int(p.BEGIN), ">": int(p.END)}
    got = dict(zip(bucket.trigrams.tolist(), mean.tolist()))
    ratios = [got[int(p._trigram(*(np.array([code[y]], np.uint64) for y in x))[0])] / e for x, e in expected.items()]
    assert 0.97 < np.mean(ratios) < 1.03 and min(ratios) > 0.8 and max(ratios) < 1.25


@pytest.mark.parametrize("c", [100, 5000, 1_000_000])
def test_one_sweep_reaches_any_number_of_tables(c):
    """Dishes of many customers, from their start to one table or to very many in one sweep."""
    level = p._Level(np.arange(500), 0.5, 5.0)
    level.seat(np.full(500, c))
    rng = np.random.default_rng(0)
    level.sweep(np.full(500, 1e-9), rng)
    assert (level.t == 1).mean() > 0.98
    level.sweep(np.full(500, 1e9), rng)
    assert (level.t > 0.9 * c).all() and (level.t <= c).all()


def test_many_customers_have_the_right_distribution():
    """Beyond the exact Stirling numbers, against a longer table of them."""
    c, s, d = 600, 30.0, 0.5
    log = p.log_stirling(c, d)[c, 1:] + np.cumsum(np.log(s + d * np.arange(c)))
    weights = np.exp(log - log.max())
    weights /= weights.sum()
    mean = (weights * np.arange(1, c + 1)).sum()
    level = p._Level(np.arange(2000), d, s)
    level.seat(np.full(2000, c))
    level.sweep(np.full(2000, 1.0), np.random.default_rng(0))
    spread = math.sqrt((weights * (np.arange(1, c + 1) - mean) ** 2).sum())
    assert abs(level.t.mean() - mean) < 0.12 * mean
    assert level.t.std() == pytest.approx(spread, rel=0.25)


def test_no_sweep_is_done_twice(monkeypatch):
    """A bucket that goes on after a round takes up its seats; it does not seat its customers from the start."""
    _, deal, sent, told = exchanged(corpus(1500), 4, monkeypatch)
    sweeps = []
    monkeypatch.setattr(p.Bucket, "sweep", lambda self, all_seats=True: sweeps.append(all_seats))
    bucket = next(p.seated(t, told[k], deal)[1] for k, t in sent.items() if k >= 0)
    assert sweeps == []  # the last round has been swept before
    assert (bucket.pair.t[bucket.pair.c > 1] > 1).any() and bucket.shared


def test_order_of_hashes():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 1000):
        for keys in (rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2), rng.integers(0, 5, n).astype(np.uint64), np.uint64((1 << 64) - 1) - rng.integers(0, 9, n).astype(np.uint64)):
            assert keys[p._order(keys)].tolist() == sorted(keys.tolist())


def test_every_sample_seats_shared_restaurants_anew(monkeypatch):
    """Restaurants that several buckets have dishes of have seats of their own in each sample, in which probabilities still sum to one."""
    learned = corpus()
    vocabulary = sorted({w for t in learned for w in t.split()})
    asked = [" ".join(f"w1 w1 {w}" for w in [*vocabulary, "unknown"]), "w1 w1"]
    texts = [x for pair in zip(learned + [""] * 2, asked + ["w2"] * 200) for x in pair]
    buckets, deal, *_ = exchanged(texts, 25, monkeypatch)
    samples = []
    moved = several = 0
    for b in buckets.values():
        seats = np.stack([b.pair.t[b.open_trigram], *(x.pair.t for x in b.beside)]) if b.beside else np.zeros((p.SAMPLES, 0))
        assert len(b.beside) in (0, p.SAMPLES - 1)
        many = b.pair.c[b.open_trigram] > 3 if b.beside else np.zeros(0, bool)
        several += many.sum()
        moved += (seats[:, many] != seats[0, many]).any(axis=0).sum()
    assert several > 50 and moved > several / 2
    name = lambda w: np.array([int(p._tokens(__import__("pyarrow").array([w]))[0][0])], np.uint64)
    assert deal.is_split(name("w1"))[0]
    keys = {int(p._trigram(name("w1"), name("w1"), w)[0]) for w in [*(name(w) for w in [*vocabulary, "unknown"]), np.array([p.END])]}
    for number in range(p.SAMPLES):
        total = 0.0
        for b in buckets.values():
            b._seat_root(number)
            got = b.predict()
            if number and b.beside:
                got[b.open_trigram] = b.beside[number - 1].predict(b.root.probability(b._base()))
            total += sum(x for k, x in zip(b.trigrams.tolist(), got.tolist()) if k in keys)
        samples.append(total)
    assert samples == pytest.approx([1] * p.SAMPLES, abs=1e-9)


def test_several_buckets_as_one(monkeypatch):
    """The mean of many samples, by the rounds as they run, with words that are split over buckets, and that of one bucket's chain."""
    texts = [x for t in corpus(400, 8, 3) for x in (t, "")]
    (one,) = exchanged(texts, 1, monkeypatch)[0].values()
    one.shared = False
    one.root.other_c[:], one.root.other_t[:] = 0, 0
    mean = np.zeros(len(one.trigrams))
    for _ in range(600):
        one.sweep()
        mean += one.predict() / 600
    expected = dict(zip(one.trigrams.tolist(), mean.tolist()))
    monkeypatch.setattr(p, "SAMPLES", 150)
    monkeypatch.setattr(p, "BURN_IN", 6)
    buckets, deal, *_ = exchanged(texts, 6, monkeypatch)
    assert len(deal.split) >= 2
    ratios = [x / expected[k] for b in buckets.values() for k, x in zip(b.trigrams.tolist(), b.sampled().tolist())]
    assert len(ratios) == len(expected) and 0.97 < np.mean(ratios) < 1.03 and min(ratios) > 0.7 and max(ratios) < 1.4
