"""Every query with SQL against that SQL, and the others for their shape."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted(n for n in entry.QUERIES)
ROWS_ONLY = sorted(set(OWN) - set(entry.ORACLES))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "item") and not hasattr(v, "tolist"):
        v = v.item()
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr([plain(v) for v in r]) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    got, expected = entry.QUERIES[name](spark, sf).toPandas(), duck.execute(entry.ORACLES[name]).fetch_df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows(spark, sf, name):
    assert entry.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert set(entry.entry(spark).columns) == {"query_id", "chunk_id", "score", "rank"}


def test_all_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
