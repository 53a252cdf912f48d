"""Kernels against brute force on generated inputs, without Spark."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrule.llm import decontaminate, packing, simhash, suffix_dedup
from ferrule.llm._blobs import press, unpress
from ferrule.llm._text import flat, runs_of, space_words, span_hashes, word_bounds

words = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14)
quick = settings(max_examples=150, deadline=None)


@quick
@given(st.lists(words, max_size=4), words, st.integers(1, 5))
def test_automaton(items, doc, window):
    found, hit = set(), set()
    for k, item in enumerate(items):
        n = min(window, len(item))
        grams = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
        for p in range(len(doc) - n + 1):
            if tuple(doc[p : p + n]) in grams:
                found.add(str(k))
                hit |= set(range(p, p + n))
    spans, got = decontaminate.SuffixAutomaton([(str(k), i) for k, i in enumerate(items)], window).scan(doc)
    assert got == found and {p for a, b in spans for p in range(a, b)} == hit
    assert sum(b - a for a, b in decontaminate.merged(spans)) == len(hit)


@quick
@given(st.lists(st.text(alphabet="ab \n\té🌉", max_size=20), max_size=5))
def test_words_and_hashes(texts):
    import pyarrow as pa

    raw, starts = flat(pa.array(texts, pa.string()))
    first, last = word_bounds(raw, starts)
    found = [bytes(raw[a:b]) for a, b in zip(first, last)]
    assert found == [w for t in texts for w in space_words(t.encode())]
    hashes = span_hashes(raw, first, last)
    assert len(set(zip(found, hashes.tolist()))) == len(set(found)) == len(set(hashes.tolist()))


@quick
@given(st.lists(st.integers(0, 3), min_size=60, max_size=400), st.data())
def test_anchors(values, data):
    raw = np.array(values, np.uint8)
    cut = data.draw(st.integers(0, len(values)))
    starts = np.array(sorted({0, cut, len(values)}))
    at, grams, first, last = suffix_dedup.anchors(raw, starts)
    own = {p: a for a, f, s in zip(at.tolist(), first.tolist(), last.tolist()) for p in range(f, s + 1)}
    places = [p for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()) for p in range(a, b - suffix_dedup.LENGTH + 1)]
    assert sorted(own) == places
    by = {}
    for p in places:  # equal strings have their anchor at the same place
        assert by.setdefault(raw[p : p + suffix_dedup.LENGTH].tobytes(), own[p] - p) == own[p] - p


@quick
@given(st.lists(st.integers(0, (1 << 64) - 1), unique=True, max_size=60), st.lists(st.integers(0, 2**32 - 1), max_size=60))
def test_blobs(keys, numbers):
    a = {"key": np.array(sorted(keys), np.uint64), "n": np.array(numbers, np.uint32), "f": np.array(numbers, np.float64)}
    assert all((unpress(press(**a))[k] == v).all() for k, v in a.items())


@quick
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), max_size=40))
def test_components(edges):
    label = list(range(21))
    for _ in range(21):
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    got = simhash.components(21, np.array([e[0] for e in edges], int), np.array([e[1] for e in edges], int))
    assert got.tolist() == label


@quick
@given(st.lists(st.tuples(st.integers(1, 45), st.integers(0, 3), st.integers(0, 5)), max_size=40), st.integers(1, 3))
def test_bins_keep_their_limits(items, most):
    rows = packing.pack([(i, size, f"s{s}", c) for i, (size, s, c) in enumerate(items)], 20, most)
    assert sum(r[3] for r in rows) == sum(i[0] for i in items)
    bins = {}
    for doc, _, _, size, number, _ in rows:
        bins.setdefault(number, []).append((size, items[doc]))
    for content in bins.values():
        rest = [i for size, i in content if size < 20]
        assert sum(size for size, _ in content) <= 20
        assert max(Counter(s for _, s, _ in rest).values(), default=0) <= most and max(Counter(c for _, _, c in rest).values(), default=0) <= 1


def test_hashes_of_spans():
    """All spans of a text, short and long: equal hashes for equal contents alone."""
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 99, 1200).astype(np.uint8)
    starts, ends = (x.ravel() for x in np.meshgrid(np.arange(0, 1200, 7), np.arange(0, 1201, 11)))
    starts, ends = starts[starts <= ends], ends[starts <= ends]
    for seed in (0, 1):
        by = {}
        for a, b, h in zip(starts.tolist(), ends.tolist(), span_hashes(raw, starts, ends, seed).tolist()):
            by.setdefault(raw[a:b].tobytes(), set()).add(h)
        assert all(len(v) == 1 for v in by.values()) and len(set().union(*by.values())) == len(by)
    values = rng.integers(0, 3, 500).astype(np.uint64)
    for n in (1, 2, 3, 5, 10):
        by = {}
        for i, h in enumerate(runs_of(values, n).tolist()):
            by.setdefault(values[i : i + n].tobytes(), set()).add(h)
        assert all(len(v) == 1 for v in by.values()) and len(set().union(*by.values())) == len(by)


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate({97: "b", 98: "a"})
    return out


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096, 8192])
def test_lines_that_collide_in_polynomials(n):
    """A Thue-Morse line and its complement differ, whatever their length."""
    import pyarrow as pa

    from ferrule.llm.quality_rules import measure

    line = thue_morse(n)
    other = line.translate({97: "b", 98: "a"})
    got = measure(pa.array([f"{line}\n{other}", f"{line}\n{line}", " ".join([*line, *other])], pa.string()))
    assert got["n_dup_lines"].tolist() == [0, 1, 0] and got["line_share"].tolist() == [0, 1, 0]
