"""Streams that lose no late row: candles and deduplication with a side output and a job that repairs what was closed.

A batch writer keeps its own watermark in the output folder (the newest event time of earlier batches less the delay), so
a replayed batch decides as it did the first time. Rows behind it go to the side table, numbered by batch; the repair reads
those that no earlier repair has read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.columns import is_buy
from tickforge.functions.timeutil import bucket
from tickforge.operators.keyed import latest_per_key
from tickforge.sources.tables import _folder, read_table
from tickforge.streaming.stateful import _numbers

DELAY = 600
CANDLE = ["chain_id", "symbol", "open_time"]


def _watermark(spark: SparkSession, path: str, n: int) -> int | None:
    """The watermark after batch ``n``."""
    if n < 0:
        return None
    return spark.read.parquet(f"{path}/mark/batch={n}").head()["watermark"]


def _mark(batch: DataFrame, path: str, n: int, before: int | None, ts: str, delay: int) -> int | None:
    """Move the watermark with the batch's newest row and keep it."""
    newest = batch.agg(F.max(ts)).head()[0]
    now = max([x for x in (before, None if newest is None else newest - delay) if x is not None], default=None)
    batch.sparkSession.createDataFrame([(now,)], "watermark long").write.mode("overwrite").parquet(f"{path}/mark/batch={n}")
    return now


def _split(batch: DataFrame, until, before: int | None) -> tuple[DataFrame, DataFrame]:
    """Rows in time and late rows, whose ``until`` the watermark has reached."""
    late = F.lit(False) if before is None else until <= before
    return batch.filter(~late), batch.filter(late)


def partial_candles(trades: DataFrame, step: int) -> DataFrame:
    """Mergeable candles per (chain, symbol, open time)."""
    return trades.groupBy("chain_id", "symbol", bucket("ts", step).alias("open_time")).agg(
        F.min_by("price", "seq").alias("open"), F.min("seq").alias("first_seq"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"), F.max("seq").alias("last_seq"), F.sum("quantity").alias("volume"), F.sum("quote_qty").alias("quote_volume"),
        F.count(F.lit(1)).alias("trade_count"), F.sum(F.when(is_buy(), F.col("quantity")).otherwise(0.0)).alias("taker_buy_base_volume"))


def merge_candles(candles: DataFrame) -> DataFrame:
    sums = ["volume", "quote_volume", "trade_count", "taker_buy_base_volume"]
    return candles.groupBy(*CANDLE).agg(
        F.min_by("open", "first_seq").alias("open"), F.min("first_seq").alias("first_seq"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "last_seq").alias("close"), F.max("last_seq").alias("last_seq"), *[F.sum(c).alias(c) for c in sums])


def candles_with_late_rows(path: str, step: int, delay: int = DELAY) -> Callable[[DataFrame, int], None]:
    """Batch writer of trades: closed candles, open ones (carried from batch to batch) and late trades, each by batch."""
    def write(batch: DataFrame, n: int) -> None:
        spark, put = batch.sparkSession, lambda df, name: df.write.mode("overwrite").parquet(f"{path}/{name}/batch={n}")
        before = _watermark(spark, path, n - 1)
        batch = batch.persist()
        in_time, late = _split(batch, bucket("ts", step) + step, before)
        put(late, "late")
        fresh = partial_candles(in_time, step)
        if n:
            fresh = merge_candles(fresh.unionByName(spark.read.parquet(f"{path}/open/batch={n - 1}")))
        now = _mark(batch, path, n, before, "ts", delay)
        closes = F.lit(False) if now is None else F.col("open_time") + step <= now
        put(fresh.filter(closes), "closed")
        put(fresh.filter(~closes), "open")
        batch.unpersist()
        folder, files = _folder(spark, f"{path}/open/batch={n - 2}")
        files.delete(folder, True)
    return write


def _late_since(spark: SparkSession, path: str) -> tuple[list[int], int]:
    """Side-table batches that no repair has read, and the number of the next repair."""
    repairs = _numbers(spark, f"{path}/repair")
    done = repairs[-1] if repairs else -1
    return [n for n in _numbers(spark, f"{path}/late") if n > done], done


def read_candles(spark: SparkSession, path: str, with_open: bool = False) -> DataFrame:
    """Closed candles as last repaired; ``with_open`` adds the ones that are still open."""
    closed = spark.read.option("basePath", f"{path}/closed").parquet(f"{path}/closed").withColumn("version", F.lit(-1))
    if _numbers(spark, f"{path}/repair"):
        closed = closed.unionByName(spark.read.option("basePath", f"{path}/repair").parquet(f"{path}/repair").withColumnRenamed("upto", "version"), True)
    out = latest_per_key(closed.drop("batch"), CANDLE, "version").drop("version")
    last = _numbers(spark, f"{path}/open")
    return out.unionByName(spark.read.parquet(f"{path}/open/batch={last[-1]}")) if with_open and last else out


def repair_candles(spark: SparkSession, path: str, step: int) -> dict[str, int]:
    """Merge late trades into the closed candles they belong to and write those candles anew, and no others.

    Returns how many trades were late and how many candles were written. Repeating it changes nothing.
    """
    batches, _ = _late_since(spark, path)
    if not batches:
        return {"late": 0, "rewritten": 0}
    late = spark.read.parquet(*[f"{path}/late/batch={n}" for n in batches])
    more = partial_candles(late, step)
    touched = read_candles(spark, path).join(more.select(*CANDLE), CANDLE, "left_semi")
    upto = batches[-1]
    merge_candles(touched.unionByName(more)).write.mode("overwrite").parquet(f"{path}/repair/upto={upto}")
    return {"late": late.count(), "rewritten": spark.read.parquet(f"{path}/repair/upto={upto}").count()}


def dedup_with_late_rows(path: str, keys: list[str], delay: int = DELAY, ts: str = "ts", step: int = 3600) -> Callable[[DataFrame, int], None]:
    """Batch writer: rows whose key is not written yet, by hour; late rows to the side table.

    Rows in time are younger than the watermark, so only the hours since then are looked through for their keys.
    """
    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        before = _watermark(spark, path, n - 1)
        batch = batch.persist()
        in_time, late = _split(batch, F.col(ts), before)
        late.write.mode("overwrite").parquet(f"{path}/late/batch={n}")
        fresh = in_time.dropDuplicates(keys).withColumn("hour", bucket(ts, step))
        stored = read_table(spark, f"{path}/rows")
        if stored is not None:
            recent = stored.filter((F.col("batch") < n) & (F.lit(before is None) | (F.col("hour") >= F.lit((before or 0) - (before or 0) % step))))
            fresh = fresh.join(recent.select(*keys), keys, "left_anti")
        # hours side by side, so that every task writes few folders; a large hour is still several tasks
        fresh = fresh.withColumn("batch", F.lit(n).cast("long")).hint("rebalance", "hour")
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "batch", "hour").parquet(f"{path}/rows")
        _mark(batch, path, n, before, ts, delay)
        batch.unpersist()
    return write


def repair_dedup(spark: SparkSession, path: str, keys: list[str], ts: str = "ts", step: int = 3600) -> dict[str, int]:
    """Add the late rows whose key was never written; repeats of written rows are only counted."""
    batches, _ = _late_since(spark, path)
    if not batches:
        return {"late": 0, "added": 0}
    late = spark.read.parquet(*[f"{path}/late/batch={n}" for n in batches])
    fresh = late.dropDuplicates(keys).withColumn("hour", bucket(ts, step))
    known = read_deduped(spark, path).join(fresh.select("hour").distinct(), "hour", "left_semi").select(*keys)
    fresh.join(known, keys, "left_anti").write.mode("overwrite").parquet(f"{path}/repair/upto={batches[-1]}")
    return {"late": late.count(), "added": spark.read.parquet(f"{path}/repair/upto={batches[-1]}").count()}


def read_deduped(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.parquet(f"{path}/rows").drop("batch")
    if not _numbers(spark, f"{path}/repair"):
        return rows
    return rows.unionByName(spark.read.option("basePath", f"{path}/repair").parquet(f"{path}/repair").drop("upto"))
