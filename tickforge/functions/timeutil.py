"""Periods, intervals and bucket arithmetic on epoch seconds (UTC)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Lookback hours per period name and seconds per interval name.
PERIOD_HOURS = {"1h": 1, "24h": 24, "7d": 168, "30d": 720, "90d": 2160, "1y": 8760, "all": None}
INTERVAL_SECONDS = {
    "1m": 60, "5m": 300, "15m": 900, "30m": 1800, "1h": 3600, "4h": 14400, "1d": 86400, "1w": 604800,
    "5min": 300, "hourly": 3600, "daily": 86400, "weekly": 604800, "monthly": 2592000,
}
KLINE_INTERVALS = {"1m": 60, "5m": 300, "30m": 1800, "1h": 3600, "1d": 86400}
FIRST_MONDAY = 345600  # 1970-01-05, the origin of calendar weeks


def period_start(period: str, as_of: int) -> int:
    """First epoch second inside ``period`` before ``as_of``; unknown names mean 24 hours."""
    hours = PERIOD_HOURS.get(period, 24)
    return 0 if hours is None else as_of - hours * 3600


def interval_seconds(interval: str) -> int:
    return INTERVAL_SECONDS.get(interval, 86400)


def in_period(ts: str | Column, period: str, as_of: int) -> Column:
    """``start <= ts <= as_of`` as a plain comparison, so it reaches the scan."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return (c >= F.lit(period_start(period, as_of))) & (c <= F.lit(as_of))


def bucket(ts: str | Column, seconds: int | Column, origin: int = 0) -> Column:
    """Start of the fixed-width bucket holding ``ts``."""
    c = F.col(ts) if isinstance(ts, str) else ts
    s = seconds if isinstance(seconds, Column) else F.lit(seconds)
    shifted = c if origin == 0 else c - F.lit(origin)
    return c - F.pmod(shifted, s)


def calendar_bucket(ts: str | Column, unit: str) -> Column:
    """Calendar truncation (hour, day, week from Monday, month) on epoch seconds."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if unit in ("hour", "hourly"):
        return bucket(c, 3600)
    if unit in ("day", "daily"):
        return bucket(c, 86400)
    if unit in ("week", "weekly", "1w"):
        return bucket(c, 604800, FIRST_MONDAY)
    return F.unix_timestamp(F.date_trunc(unit.replace("monthly", "month"), F.timestamp_seconds(c)))


def spine(spark: SparkSession, start: int, end: int, step: int) -> DataFrame:
    """One row per bucket start in ``[start, end]``: columns ``idx`` and ``timestamp``."""
    n = max(0, (end - start) // step + 1)
    return spark.range(n).select(
        F.col("id").alias("idx"), (F.lit(start).cast("long") + F.col("id") * step).alias("timestamp")
    )


def series_start(rows: DataFrame, period: str, as_of: int, step: int, ts: str = "ts") -> int:
    """Where a period's series begins; a period without a limit begins with the first row's bucket."""
    if PERIOD_HOURS.get(period, 24) is not None:
        return period_start(period, as_of)
    first = rows.agg(F.min(ts)).head()[0]
    return as_of - as_of % step if first is None else first - first % step


def bucket_index(ts: str | Column, start: int, step: int) -> Column:
    """Position of ``ts`` on a spine that begins at ``start``: turns a range join into an equi-join."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.floor((c - F.lit(start)) / F.lit(step)).cast("long")
