"""Queries of the subpackage that SQL can say, against their SQL."""

import duckdb
import pytest

from capstrata.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark", "conversations"):
        db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    cursor = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    shown = lambda rows: sorted(repr([f"{x:.9g}" if isinstance(x, float) else x for x in r]) for r in rows)
    assert shown(df.select(*names).collect()) == shown(cursor.fetchall())
