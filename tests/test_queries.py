"""Every query with an SQL oracle against DuckDB on the same tables."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = __spark_entry__.queries(), __spark_entry__.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return "NULL" if v is None else str(list(map(plain, v))) if isinstance(v, (list, tuple)) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, data_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{data_dir}/{t}.parquet')")
    df = QUERIES[name](spark, data_dir)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select([df[c] for c in columns]).collect())
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
    assert got == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns
