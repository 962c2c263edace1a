"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import decimal
import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.isoformat() if isinstance(v, datetime.date) else round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    df = entry.queries()[name](spark, DATA)
    assert sorted(df.columns) == sorted(columns)
    pick = [df.columns.index(c) for c in columns]
    got = [tuple(plain(r[i]) for i in pick) for r in df.collect()]
    assert sorted(got, key=repr) == sorted((tuple(map(plain, r)) for r in want), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
