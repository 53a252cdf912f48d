"""The newer operators against their SQL."""

import duckdb
import pytest

from ferrule.llm import queries


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_warc_archive", "op13_merkle_manifest"])
def test_same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(expected, key=repr)
