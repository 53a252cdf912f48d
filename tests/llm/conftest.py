"""Awkward tables: nulls, empty and long texts, ties, repeats, clashing columns."""

import pytest

WORD = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def prose(seed: int, n: int) -> str:
    import random

    rng = random.Random(seed)
    out = []
    for i in range(n):
        out.append(rng.choice(WORD) + str(rng.randrange(400)))
        if i % 11 == 10:
            out.append("\n")
    return " ".join(out)


ROWS = [
    (1, prose(1, 120)),
    (2, prose(1, 120)),  # an exact copy
    (3, prose(1, 120) + " more"),  # a near copy
    (4, None),
    (5, ""),
    (6, " \t\n\x0b "),
    (7, "one"),
    (8, "one two"),
    (None, prose(9, 60)),
    (None, "no id at all"),
    (10, prose(10, 30)),
    (10, prose(10, 30)),  # a row that repeats
    (11, "ÄÖ Größe 中文 文字 🌉 " + prose(11, 20)),
    (12, prose(12, 30_000)),  # a very long text
    (13, "x" * 5000),
    (14, "same same same same same same same same same same same same"),
    (15, "Released under the MIT License.\n" + prose(15, 40)),
    (16, prose(16, 40) + "\n" + prose(1, 60)),  # a shared passage
    (17, "nul\x00byte and\r\nline ends\rof all\x85kinds"),
    (2**62, prose(17, 30)),
    (-5, prose(18, 30)),
]


@pytest.fixture(scope="session")
def awkward(spark):
    """The rows, with columns whose names operators might use within."""
    rows = [(i, t, "en", "src", len(t or ""), 1, "k", 2.0, b"b") for i, t in ROWS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id long, key string, score double, blob binary"
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.limit(0)


@pytest.fixture
def small_tasks(monkeypatch):
    """So many tasks and shards that small tables meet all exchanges."""
    from ferrule.llm import pitman_yor, simhash, suffix_dedup

    monkeypatch.setattr(pitman_yor, "RUN_BYTES", 20_000)
    monkeypatch.setattr(pitman_yor, "TASK_BYTES", 40_000)
    monkeypatch.setattr(simhash, "SHARD_ROWS", 40)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 50_000)
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 60_000)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="session")
def rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]
