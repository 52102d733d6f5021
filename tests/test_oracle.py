"""Every query with SQL against DuckDB on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from cachelens import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(str(float(r[i])) if isinstance(r[i], (int, float)) and not isinstance(r[i], bool) else str(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, small, name):
    df = catalog.queries()[name](spark, small)
    rows = [tuple(r) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql:
        rel = duck.sql(sql)
        assert norm(rows, df.columns) == norm(rel.fetchall(), rel.columns)
    else:
        assert rows


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(catalog.queries()) <= set(entry.queries())
