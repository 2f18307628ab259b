"""Query registration and the SQL views shared by the check queries."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.fixtures import Fixtures

QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}
SQL: dict[str, str] = {}
VIEWS: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register a plan under ``key`` with its equivalent SQL (views named fx_* / q_* are expanded)."""
    def register(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
            VIEWS.setdefault(f"q_{key}", sql)
        return fn
    return register


def nudged(c, digits: int = 4):
    """Round after a tiny shift, so decimal ties such as 1.00005 fall the same way in both engines."""
    return F.round((F.col(c) if isinstance(c, str) else c) + F.lit(1e-9), digits)


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def _needed(sql: str, done: list[str]) -> None:
    for name in dict.fromkeys(re.findall(r"\b(?:fx|q)_\w+", sql)):
        if name in VIEWS and name not in done:
            _needed(VIEWS[name], done)
            if name not in done:
                done.append(name)


def compose(sql: str) -> str:
    """The statement with every view it needs as a common table expression."""
    deps: list[str] = []
    _needed(sql, deps)
    if not deps:
        return sql.strip()
    ctes = ", ".join(f"{d} AS ({VIEWS[d].strip()})" for d in deps)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes}, {body[5:]}"
    return f"WITH {ctes} {body}"


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
    return {k: bind(fn) for k, fn in QUERIES.items()}


def check_sql() -> dict[str, str]:
    return {k: compose(s) for k, s in SQL.items()}


def rounded(df: DataFrame, two: str = "", four: str = "", six: str = "") -> DataFrame:
    """Round the named columns (space separated) with the same tie shift the check SQL uses."""
    for names, digits in ((two, 2), (four, 4), (six, 6)):
        for c in names.split():
            df = df.withColumn(c, nudged(c, digits))
    return df


def r2(expr: str, name: str | None = None) -> str:
    return f"round({expr} + 1e-9, 2) AS {name or expr}"


def r4(expr: str, name: str | None = None) -> str:
    return f"round({expr} + 1e-9, 4) AS {name or expr}"
