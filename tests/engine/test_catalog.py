import math
import os

import pytest

import __spark_entry__ as entry
from tessera.operators import chunking as CH

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "isoformat"):
        return value.isoformat()[:19]
    if isinstance(value, float):
        return round(value, 6)
    return value.item() if hasattr(value, "item") else value


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str(tuple(plain(r[i]) for i in order)) for r in found)


@pytest.mark.parametrize("name", sorted(entry.catalog.queries()))
def test_query(spark, sf, oracle, name):
    df = entry.queries()[name](spark, sf)
    got = [tuple(r) for r in df.collect()]
    sql = entry.catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = oracle.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())


def test_every_strategy_meets_every_document(spark, sf):
    got = {tuple(r) for r in entry.queries()["chunk_strategies"](spark, sf).select("doc_id", "strategy").distinct().collect()}
    docs = [r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").where("trim(text) != ''").select("doc_id").collect()]
    assert {(d, s) for d in docs for s in CH.P.STRATEGIES} <= got


def test_entry(spark):
    assert entry.entry(spark).limit(5).count() >= 0
