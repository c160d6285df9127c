"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if type(v).__name__ in ("Decimal", "float", "int"):
        return f"{float(v):.6g}"
    if type(v).__name__ == "date":
        return f"{v} 00:00:00"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(got.columns)
    mine = sorted(tuple(plain(r[c]) or "~" for c in columns) for r in df.collect())
    at = [got.columns.index(c) for c in columns]
    theirs = sorted(tuple(plain(r[i]) or "~" for i in at) for r in got.fetchall())
    assert len(mine) == len(theirs) and len(mine) > 0
    wrong = [(a, b) for a, b in zip(mine, theirs) if a != b]
    assert not wrong, wrong[:3]


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
