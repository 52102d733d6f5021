"""Operators with SQL against it: on the small tables and on tables of odd rows."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from cachelens.llm import queries
from tests.test_oracle import norm

WORDS = "river stone paper cloud garden window silver market winter candle forest bridge".split()
LONG = " ".join(WORDS[i * i % 11] + str(i % 53) for i in range(4_000))


def compared(spark, folder, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df, rel = queries.queries()[name](spark, str(folder)), con.sql(queries.oracle_sql()[name])
    rows = [tuple(r) for r in df.collect()]
    assert norm(rows, df.columns) == norm(rel.fetchall(), rel.columns)
    return [dict(zip(df.columns, r, strict=True)) for r in rows]


@pytest.fixture
def odd(tmp_path):
    five = " ".join(WORDS[:5])
    texts = [None, "", "  ", "!?", "one", "One!", five, five + ".", five + " " + WORDS[5], LONG, LONG + " end", "start " + LONG, LONG.upper(), "ÄÖÜ ß \u0130stanbul 漢字", "a a a a a a a a a", "a a a a a a a a"]
    docs = {"doc_id": pa.array([*range(len(texts) - 1), None], pa.int64()), "text": pa.array(texts, pa.string()), "size": [7] * len(texts), "shard": ["x"] * len(texts)}
    pq.write_table(pa.table(docs), tmp_path / "documents.parquet")
    urls = [None, "", "no scheme", "://", "HTTP://EXAMPLE.NET/en/x?y", "http://example.net", "http://example.net/en", "http://a.example.net/EN/", "http://xexample.net/en/", "http://net/", "http://b.org/fr/q#z", "http://b.org/fr?x", "http://example.com/de/1", "http://example.com/en/1", "http://example.com/en/1", "ftp://ü.example/ä/😀", "http://x.io/" + "ab/" * 30_000, "a://b://c/d"]
    urls += [f"http://s{i % 9}.site{i % 13}.net/p{i}" for i in range(60)] + [f"http://t{i % 7}.org/fr/{WORDS[i % 12]}" for i in range(60)]
    urls += ["http://s3.site4.nex/p7", "http://s5.site6.nex/p11", "http://t3.orgs/fr/cloud", "http://t2.orgs/fr/stone"]
    pages = {"page_id": pa.array([0, 0, *range(2, len(urls))], pa.int64()), "url": pa.array(urls, pa.string()), "host": ["h"] * len(urls), "score": [1.0] * len(urls)}
    pq.write_table(pa.table(pages), tmp_path / "pages.parquet")
    return tmp_path


@pytest.fixture
def empty(tmp_path):
    pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string())}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"page_id": pa.array([], pa.int64()), "url": pa.array([], pa.string())}), tmp_path / "pages.parquet")
    return tmp_path


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, small, name):
    assert compared(spark, small, name)


@pytest.mark.parametrize("name", ["op5_url_filter", "op8_rendezvous_sharding"])
def test_sql_of_odd_rows(spark, odd, name):
    rows = compared(spark, odd, name)
    if name == "op5_url_filter":
        alike = [(r["host"][0], r["rule"], r["verdict"]) for r in rows if r["host"].endswith((".nex", ".orgs"))]
        assert sorted(alike) == [("s", None, "block")] * 2 + [("t", None, "allow")] * 2


def test_classes_of_odd_rows(spark, odd):
    """Every key but the last is there; a row without a key is a row of its own in the SQL as well."""
    pq.write_table(pq.read_table(odd / "documents.parquet").slice(0, 15), odd / "documents.parquet")
    rows = {r["doc_id"]: r["class_id"] for r in compared(spark, odd, "op6_bagminhash")}
    assert len({rows[i] for i in (9, 10, 11, 12)}) == 1 and rows[4] == rows[5] == 4 and len({rows[i] for i in range(4)}) == 4


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql_of_empty_tables(spark, empty, name):
    assert compared(spark, empty, name) == []
