"""Every registered core query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from podium.plans import more_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem".split()


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((key(r) for r in got.select(*order).collect())) == sorted(key(r) for r in want.select(", ".join(order)).fetchall())
