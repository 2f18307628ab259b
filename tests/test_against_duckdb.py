"""Every registered query against its SQL on DuckDB, value by value."""

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry_points
from tickforge.registry import load

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
KEYS = sorted(load().spark_queries())
ONLY = os.environ.get("TICKFORGE_KEYS")
if ONLY:
    KEYS = [k for k in KEYS if k in ONLY.split(",")]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return v + 0.0 if v else 0.0
    return v


@pytest.mark.parametrize("key", KEYS)
def test_same_rows(key, spark, sf, duck):
    df = entry_points.queries()[key](spark, sf)
    cols = sorted(df.columns)
    ours = Counter(tuple(plain(row[c]) for c in cols) for row in df.collect())
    cur = duck.execute(entry_points.oracle_sql()[key])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = Counter(tuple(plain(row[names.index(c)]) for c in cols) for row in cur.fetchall())
    assert ours == theirs
