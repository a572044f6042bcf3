"""The driver's contract: queries against their SQL on the small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from capstrata.plans import changes, reads, submissions, texts

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = reads.SQL | texts.SQL | changes.SQL | submissions.SQL


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else f"{x:.9g}"
    return x


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_its_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    cursor = db.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    got = sorted(repr([plain(x) for x in r]) for r in df.select(*[f"`{c}`" for c in names]).collect())
    assert got == sorted(repr([plain(x) for x in r]) for r in cursor.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() == 5
    assert set(SQL) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
