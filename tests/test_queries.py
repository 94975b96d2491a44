"""Every query with SQL against DuckDB on the smallest tables; the others must run."""

import os

import duckdb
import pytest

from tidemill.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def rows(p):
    p = p[sorted(p.columns)]
    for c in p.columns:
        if str(p[c].dtype).startswith("datetime"):
            p = p.assign(**{c: p[c].astype("datetime64[us]").astype(str)})
        elif p[c].dtype.kind == "f" or str(p[c].dtype).startswith("Float"):
            p = p.assign(**{c: p[c].astype(float).round(5) + 0.0})
    p = p.astype(object).where(p.notna(), None)
    return sorted(map(str, p.values.tolist()))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
