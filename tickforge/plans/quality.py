"""Data-quality and sync jobs: missed trades, gaps, integrity, recommendations, one-shot sync."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.functions.columns import at_least, format_duration, ratio
from tickforge.operators.keyed import insert_ignore, upsert_replace
from tickforge.operators.temporal import asof_lookup, islands
from tickforge.plans import volume
from tickforge.session import settle
from tickforge.sources import tables

PROCESSING_RATE = 100  # fixed value: trades per second assumed by the sync estimates


def processed_ids(sync_log: DataFrame, service: str = "analytics") -> DataFrame:
    return sync_log.filter((F.col("status") == "processed") & (F.col("service") == service)).select("trade_id").distinct()


def missed_trades(trades: DataFrame, sync_log: DataFrame, from_ts: int = 0, cap: int | None = None) -> DataFrame:
    """Trades after ``from_ts`` not marked processed, oldest first; null log ids never hide a trade."""
    out = trades.filter(F.col("ts") > from_ts).join(
        processed_ids(sync_log).filter(F.col("trade_id").isNotNull()), "trade_id", "left_anti")
    return out if cap is None else out.orderBy("seq").limit(cap)


def coverage_by_time(trades: DataFrame, sync_log: DataFrame) -> DataFrame:
    """Trades and processed trades per second: the one pass over trades every health figure comes from."""
    done = processed_ids(sync_log).withColumn("done", F.lit(1))
    return trades.join(done, "trade_id", "left").groupBy("ts").agg(
        F.count("done").alias("done"), F.count(F.lit(1)).alias("trades"))


def data_gaps(trades: DataFrame, sync_log: DataFrame) -> DataFrame:
    """Runs of consecutive timestamps without a processed trade, labelled head, middle or tail.

    A run that reaches the newest trade is a tail even when it starts at the oldest.
    """
    return gaps_from_coverage(settle(coverage_by_time(trades, sync_log)))


def gaps_from_coverage(per_ts: DataFrame) -> DataFrame:
    runs = islands(per_ts.withColumn("hit", (F.col("done") > 0).cast("int")), "ts", "hit", "trades").filter(F.col("hit") == 0)
    span = per_ts.agg(F.struct(F.min("ts").alias("lo"), F.max("ts").alias("hi")).alias("s")).scalar()
    return runs.withColumn("s", span).select(
        F.when(F.col("end") == F.col("s.hi"), "tail").when(F.col("start") == F.col("s.lo"), "head").otherwise("middle").alias("type"),
        F.col("start").alias("from_ts"), F.col("end").alias("to_ts"), F.col("weight").alias("trade_count"))


def missed_trades_in_gaps(trades: DataFrame, gaps: DataFrame, sync_log: DataFrame) -> DataFrame:
    """Unprocessed trades inside any of the gaps.

    Gaps are disjoint, so only the last one that begins at or before a second can hold it: each second with trades is
    looked up once, whatever the number of gaps.
    """
    starts = gaps.select(F.col("from_ts").alias("ts"), "to_ts")
    inside = asof_lookup(trades, starts, [], "ts", ["to_ts"], "to_ts").filter(F.col("ts") <= F.col("to_ts")).select("ts")
    return trades.join(inside, "ts", "left_semi").join(processed_ids(sync_log), "trade_id", "left_anti")


def last_processed_ts(trades: DataFrame, sync_log: DataFrame) -> DataFrame:
    """Newest processed trade time, falling back to the first trade."""
    done = trades.join(processed_ids(sync_log), "trade_id", "left_semi").agg(F.max("ts")).scalar()
    return trades.agg(F.min("ts").alias("first")).select(F.coalesce(done, "first").alias("last_processed_ts"))


def continuous_from_start(trades: DataFrame, sync_log: DataFrame) -> DataFrame:
    first = trades.agg(F.min("ts")).scalar()
    hit = trades.filter(F.col("ts") == first).join(processed_ids(sync_log), "trade_id", "left_semi")
    return hit.agg((F.count(F.lit(1)) > 0).alias("continuous_from_start"))


def _score(done, total):
    return F.round(F.coalesce(ratio(done, total) * 100, F.lit(100.0)), 2)


def integrity_score(trades: DataFrame, sync_log: DataFrame) -> DataFrame:
    """Processed share in percent with two places; 100 when there is nothing to process."""
    done = processed_ids(sync_log).withColumn("done", F.lit(1))
    return trades.join(done, "trade_id", "left").agg(
        F.count(F.lit(1)).alias("total_trades"), F.count("done").alias("processed_trades")
    ).withColumn("integrity_score", _score("processed_trades", "total_trades")) \
        .withColumn("status", at_least("integrity_score", [(98, "excellent"), (95, "good"), (90, "fair")], "poor"))


def sync_health(trades: DataFrame, sync_log: DataFrame, etl_healthy: bool = True) -> DataFrame:
    """One row: lag, gaps, integrity and the recommended action."""
    per_ts = settle(coverage_by_time(trades, sync_log))
    gaps = gaps_from_coverage(per_ts).agg(F.struct(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("type") == "tail", 1)).alias("tail"),
        F.count(F.when(F.col("type") == "middle", 1)).alias("middle"),
        F.coalesce(F.sum("trade_count"), F.lit(0)).alias("missed")).alias("g")).scalar()
    cold = sync_log.filter((F.col("status") == "processed") & (F.col("service") == "analytics")).agg(F.count(F.lit(1)) == 0).scalar()
    done = F.col("done") > 0
    base = per_ts.agg(
        F.max("ts").alias("latest_trade_ts"), F.coalesce(F.max(F.when(done, F.col("ts"))), F.min("ts")).alias("last_processed_ts"),
        _score(F.sum("done"), F.sum("trades")).alias("integrity_score"), F.min_by(done, "ts").alias("continuous_from_start")
    ).withColumn("g", gaps).withColumn("is_cold_start", cold)
    lag = (F.col("latest_trade_ts") - F.col("last_processed_ts")) / 60
    return base.withColumn("lag_minutes", F.round(lag, 4)).select(
        "latest_trade_ts", "last_processed_ts", "lag_minutes", F.col("g.total").alias("total_gaps"),
        F.col("g.tail").alias("tail_gaps"), F.col("g.middle").alias("middle_gaps"), F.col("g.missed").alias("missed_trades"),
        "integrity_score", "continuous_from_start", "is_cold_start",
        F.when(F.col("is_cold_start"), "COMPREHENSIVE_SYNC_REQUIRED").when(F.lit(not etl_healthy), "ETL_SYNC_REQUIRED")
        .when((F.col("g.middle") > 0) | (F.col("integrity_score") < 95), "COMPREHENSIVE_SYNC_REQUIRED")
        .when(F.col("lag_minutes") > 60, "IMMEDIATE_SYNC_REQUIRED").when(F.col("lag_minutes") > 5, "SYNC_RECOMMENDED")
        .otherwise("HEALTHY").alias("recommendation"),
        ((F.col("lag_minutes") < 5) & (F.col("g.middle") == 0) & (F.col("integrity_score") > 98)).alias("is_healthy"))


def cold_start_analysis(trades: DataFrame, as_of: int) -> DataFrame:
    """Size, span and the suggested first sync with time estimates."""
    a = trades.agg(F.count(F.lit(1)).alias("total_trades"), F.count(F.when(F.col("ts") >= as_of - 7 * 86400, 1)).alias("recent_trades"),
                   F.min("ts").alias("earliest"), F.max("ts").alias("latest"))
    n = F.col("total_trades")
    return a.withColumn("span_days", F.round((F.col("latest") - F.col("earliest")) / 86400, 4)).withColumn(
        "recommended_strategy", F.when(n < 1000, "full").when(n < 100_000, "recent").otherwise("skip-historical")).withColumn(
        "full_sync_seconds", F.ceil(n / PROCESSING_RATE)).withColumn(
        "recent_sync_seconds", F.ceil(F.col("recent_trades") / PROCESSING_RATE)).withColumn(
        "full_sync_text", format_duration("full_sync_seconds"))


def sync_mark(sync_log: DataFrame, trade_ids: DataFrame, status: str, as_of: int, service: str = "analytics",
              skip_existing: bool = False) -> DataFrame:
    """Mark trades processed, error or skipped; ``skip_existing`` leaves earlier marks alone."""
    marks = trade_ids.select("trade_id", F.lit(service).alias("service"), F.lit(status).alias("status"),
                             F.lit(as_of).cast("long").alias("processed_at"))
    write = insert_ignore if skip_existing else upsert_replace
    return write(sync_log.select("trade_id", "service", "status", "processed_at"), marks, ["trade_id", "service"], "processed_at")


def trade_transform(trades: DataFrame) -> DataFrame:
    return trades.select("trade_id", "symbol", "price", "quantity", "side", "ts", (F.col("price") * F.col("quantity")).alias("volume"))


def sync_run(trades: DataFrame, sync_log: DataFrame, path: str, as_of: int, strategy: str | None = None) -> DataFrame:
    """Choose a strategy, fill gaps, refresh aggregates and roll them up, as set operations.

    Standard covers trades after the last processed one, comprehensive every gap, cold-start everything.
    Written under ``path``: trade_aggregates (by date), trades_rollup_daily and sync_log. Re-running with
    the same inputs rewrites the same partitions with the same rows.
    """
    spark = trades.sparkSession
    health = sync_health(trades, sync_log).head()
    chosen = strategy or ("cold-start" if health["is_cold_start"] else "comprehensive"
                          if health["recommendation"] == "COMPREHENSIVE_SYNC_REQUIRED" else "standard")
    from_ts = health["last_processed_ts"] if chosen == "standard" else -1
    work = missed_trades(trades, sync_log, from_ts)
    days = work.select(F.floor(F.col("ts") / 86400).alias("day")).distinct()
    touched = trades.withColumn("day", F.floor(F.col("ts") / 86400)).join(days, "day", "left_semi").drop("day")
    tables.replace_bucket(volume.trade_aggregates_hourly(touched), f"{path}/trade_aggregates", "timestamp")
    stored = spark.read.parquet(f"{path}/trade_aggregates").drop("date")
    tables.replace_bucket(volume.trades_rollup(stored, "daily"), f"{path}/trades_rollup_daily", "time_bucket")
    marked = sync_mark(sync_log, work, "processed", as_of)
    marked.write.mode("overwrite").parquet(f"{path}/sync_log")
    log = spark.read.parquet(f"{path}/sync_log")
    done = log.filter((F.col("processed_at") == as_of) & (F.col("status") == "processed")).agg(F.count(F.lit(1))).scalar()
    buckets = stored.agg(F.count(F.lit(1))).scalar()
    return integrity_score(trades, log).select(
        F.lit(chosen).alias("strategy"), done.alias("marked_trades"), buckets.alias("aggregate_rows"),
        F.col("integrity_score").alias("integrity_after"))


def table_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows and presence status per table."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.when(F.col("row_count") > 0, "ok").otherwise("empty").alias("status"))
        out = one if out is None else out.unionByName(one)
    return out


def metrics_trend(metrics: DataFrame, cols: list[str]) -> DataFrame:
    """Change of every counter against the previous entry of its source (one entry per monitoring tick)."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("ts")
    return metrics.select("*", *[(F.col(c) - F.lag(c).over(w)).alias(f"{c}_change") for c in cols])


def counter_rate(counters: DataFrame, cols: list[str], window: int = 2) -> DataFrame:
    """Per-minute rate of monotonic counters over the last ``window`` intervals of each source."""
    from tickforge.operators.keyed import top_per_group

    tail = top_per_group(counters, ["source"], [F.col("ts").desc()], window + 1)
    span = (F.max("ts") - F.min("ts")) / 60
    rate = lambda c: ratio(F.max_by(c, "ts") - F.min_by(c, "ts"), span).alias(f"{c}_per_minute")
    return tail.groupBy("source").agg(*[rate(c) for c in cols])
