"""Text queries that SQL can express, against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from tickforge.llm import queries

TABLES = "documents embeddings pages benchmark labels conversations".split()


def rows_of(sql, sf, con=None):
    con = con or duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
@pytest.mark.parametrize("key", sorted(queries.SQL))
def test_same_rows(key, sf, spark):
    df = queries.QUERIES[key](spark, sf)
    names, theirs = rows_of(queries.SQL[key], sf)
    assert sorted(names) == sorted(df.columns)
    ours = df.select(*names).collect()
    assert ordered(tuple(r) for r in ours) == ordered(theirs)


def test_entry_points_hold_the_text_queries():
    held, sql = entry_points.queries(), entry_points.oracle_sql()
    assert set(queries.QUERIES) <= set(held) and set(queries.SQL) <= set(sql) and set(sql) <= set(held)
