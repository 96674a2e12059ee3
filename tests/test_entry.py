"""Entry points, and each query's result against DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry_points
from prismcol.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def near(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return abs(a - b) <= 2e-5
    return a == b or str(a) == str(b)


def test_entry(spark):
    assert entry_points.entry(spark).count() == 17
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    df, rel = QUERIES[name](spark, DATA), con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    columns = sorted(df.columns)
    key = lambda r: tuple("" if v is None else str(v) for v in r)
    mine = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    theirs = sorted((tuple(dict(zip(rel.columns, r))[c] for c in columns) for r in rel.fetchall()), key=key)
    assert len(mine) == len(theirs) and all(near(float(x) if hasattr(x, "as_tuple") else x, float(y) if hasattr(y, "as_tuple") else y) for a, b in zip(mine, theirs) for x, y in zip(a, b))
