"""Tables with more rows than a page of 200 has room for, against the SQL."""

import duckdb
import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["tbl_cells", "tbl_elements"])
def test_orders_of_many_lines(spark, tmp_path, name):
    duckdb.sql(f"""COPY (SELECT CAST(o AS BIGINT) AS l_orderkey, CAST(n AS BIGINT) AS l_partkey, CAST(n % 7 AS BIGINT) AS l_suppkey, CAST(n AS INTEGER) AS l_linenumber, CAST(n AS DOUBLE) AS l_quantity, CAST(n AS DOUBLE) AS l_extendedprice,
        0.1 AS l_discount, 0.1 AS l_tax, DATE '2000-01-01' AS l_shipdate, 'N' AS l_returnflag, 'O' AS l_linestatus FROM range(1, 4) a(o), range(1, 61) b(n) WHERE n <= o * 20) TO '{tmp_path}/lineitem.parquet'""")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = [tuple(r[c] for c in names) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(want.fetchall())
