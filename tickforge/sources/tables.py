"""Partitioned Parquet tables: idempotent bucket replacement, incremental refresh, retention, backup."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.timeutil import interval_seconds

FILES_PER_DAY = 8


def with_date(rows: DataFrame, bucket: str) -> DataFrame:
    return rows.withColumn("date", F.to_date(F.timestamp_seconds(bucket)))


def replace_bucket(rows: DataFrame, path: str, bucket: str = "bucket", extra: tuple[str, ...] = (),
                   files_per_day: int = FILES_PER_DAY) -> None:
    """Write rows by (extra..., date) and replace exactly the partitions present in ``rows``; re-runs are no-ops.

    A day is spread by a hash of its rows over up to ``files_per_day`` tasks and files; raise it with the rows of a day.
    """
    keys = [*extra, "date"]
    dated = with_date(rows, bucket)
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(files_per_day))
    (dated.repartition(*keys, spread).sortWithinPartitions(*keys, bucket).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path))


def _folder(spark: SparkSession, path: str):
    """The path and the file system that holds it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored table, or None before the first write; a table that cannot be read is an error."""
    folder, files = _folder(spark, path)
    return spark.read.parquet(path) if files.exists(folder) else None


def clear_days(spark: SparkSession, path: str, start: int, end: int, keep: set[datetime.date]) -> None:
    """Remove the stored days in ``[start, end)`` that are not in ``keep``."""
    for day in range(start // 86400, -(-end // 86400)):
        date = datetime.date(1970, 1, 1) + datetime.timedelta(days=day)
        if date not in keep:
            folder, files = _folder(spark, f"{path}/date={date.isoformat()}")
            files.delete(folder, True)


def incremental_bucket_refresh(source: DataFrame, path: str, aggregate: Callable[[DataFrame], DataFrame], as_of: int,
                               interval: str, start_offset: int, end_offset: int = 0, ts_col: str = "ts",
                               bucket: str = "bucket") -> None:
    """Recompute the whole days touched by ``[as_of - start_offset, as_of - end_offset]`` and replace them.

    Days are the storage partitions, so the source filter covers complete partitions and the replaced
    partitions are complete too. A touched day that has no rows any more is removed.
    """
    step = max(interval_seconds(interval), 86400)
    lo = (as_of - start_offset) // step * step
    hi = ((as_of - end_offset) // step + 1) * step
    fresh = aggregate(source.filter((F.col(ts_col) >= lo) & (F.col(ts_col) < hi)))
    replace_bucket(fresh, path, bucket)
    days = with_date(fresh, bucket).select("date").distinct().collect()  # at most the days of the refreshed span
    clear_days(source.sparkSession, path, lo, hi, {r["date"] for r in days})


def incremental_since_max(source: DataFrame, path: str, aggregate: Callable[[DataFrame], DataFrame], ts_col: str = "ts",
                          bucket: str = "bucket") -> int:
    """Aggregate from the day of the newest stored bucket on (boundary bucket included) and replace those days. If that day
    has no rows any more it is removed; no later day is stored."""
    stored = read_table(source.sparkSession, path)
    last = stored.agg(F.max(bucket)).head()[0] if stored is not None else None
    since = 0 if last is None else last - last % 86400
    fresh = aggregate(source.filter(F.col(ts_col) >= since))
    replace_bucket(fresh, path, bucket)
    if last is not None:
        keep = with_date(fresh.filter(F.col(bucket) < since + 86400), bucket).select("date").distinct().collect()  # one day at most
        clear_days(source.sparkSession, path, since, since + 86400, {r["date"] for r in keep})
    return since


def retention_filter(rows: DataFrame, ts_col: str, keep_seconds: int, as_of: int) -> DataFrame:
    return rows.filter(F.col(ts_col) >= as_of - keep_seconds)


def backup_table(spark: SparkSession, path: str, suffix: str) -> str:
    """Copy of a table beside it, refused if the copy exists."""
    target = f"{path.rstrip('/')}_backup_{suffix}"
    spark.read.parquet(path).write.mode("errorifexists").parquet(target)
    return target
