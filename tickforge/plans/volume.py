"""Volume, trade-count and price aggregates per bucket and symbol.

Input trades: trade_id, user_id, symbol, side, is_buyer, price, quantity, quote_qty, ts (epoch s), seq.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.columns import is_buy, ratio0, sum_if, time_order
from tickforge.functions.timeutil import (
    PERIOD_HOURS, bucket, bucket_index, calendar_bucket, in_period, interval_seconds, period_start, series_start, spine,
)
from tickforge.session import settle


def bucket_metrics(trades: DataFrame, **keys: Column) -> DataFrame:
    """The common aggregate set per key; unused columns are pruned by the optimizer.

    Keys may hold trades of several chains, so the first and last trade are those by time.
    """
    order = time_order(trades)
    return trades.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(
        F.sum("quote_qty").alias("volume"), F.count(F.lit(1)).alias("trades_count"),
        F.count_distinct("user_id").alias("unique_traders"), F.avg("price").alias("avg_price"),
        F.max("price").alias("high_price"), F.min("price").alias("low_price"),
        F.min_by("price", order).alias("open_price"), F.max_by("price", order).alias("close_price"),
        F.avg("quote_qty").alias("avg_trade_size"), F.max("quote_qty").alias("largest_trade"),
        F.min("ts").alias("first_trade_time"), F.max("ts").alias("last_trade_time"),
        sum_if(is_buy(), "quote_qty").alias("buy_volume"), sum_if(~is_buy(), "quote_qty").alias("sell_volume"))


def _symbol(df: DataFrame, symbol: str | None) -> DataFrame:
    return df if symbol in (None, "all") else df.filter(F.col("symbol") == symbol)


def _among(df: DataFrame, symbols: list[str] | None) -> DataFrame:
    return df.filter(F.col("symbol").isin(symbols)) if symbols else df


def period_counts(trades: DataFrame, as_of: int) -> DataFrame:
    """Trades inside every named period, in one pass."""
    names = list(PERIOD_HOURS)
    one = trades.agg(*[F.count(F.when(in_period("ts", p, as_of), 1)).alias(p) for p in names])
    rows = F.array(*[F.struct(F.lit(p).alias("period"), F.lit(period_start(p, as_of)).cast("long").alias("start"),
                              F.col(p).alias("trades")) for p in names])
    return one.select(F.explode(rows).alias("x")).select("x.*")


def trades_summary(trades: DataFrame, period: str, as_of: int, symbol: str | None = None) -> DataFrame:
    t = _symbol(trades.filter(in_period("ts", period, as_of)), symbol)
    return t.agg(F.count(F.lit(1)).alias("total_trades"), F.coalesce(F.sum("quote_qty"), F.lit(0.0)).alias("total_volume"),
                 F.count_distinct("user_id").alias("unique_traders"))


def trades_count_series(trades: DataFrame, period: str, interval: str, as_of: int,
                        symbol: str | None = None) -> DataFrame:
    """Per calendar bucket: trades, volume, average size and distinct traders; newest first."""
    t = _symbol(trades.filter(in_period("ts", period, as_of)), symbol)
    m = bucket_metrics(t, timestamp=calendar_bucket("ts", interval))
    return m.select("timestamp", F.col("trades_count").alias("trade_count"), "volume", "avg_trade_size",
                    "unique_traders").orderBy(F.col("timestamp").desc())


def symbol_stats(pools: DataFrame, trades: DataFrame, period: str, as_of: int) -> DataFrame:
    """Per symbol with trades in the period, by volume. The period is part of the join side, not a filter after it."""
    m = bucket_metrics(trades.filter(in_period("ts", period, as_of)), symbol=F.col("symbol"))
    names = pools.select(F.col("order_book").alias("symbol"), "coin").distinct()  # one book per chain
    return names.join(m, "symbol").select(
        "symbol", "coin", F.col("volume").alias("total_volume"), F.col("trades_count").alias("total_trades"),
        "unique_traders", "low_price", "high_price", "avg_price").orderBy(F.col("total_volume").desc(), "symbol")


def hourly_trading_stats(trades: DataFrame, hour_start: int, hour_end: int) -> DataFrame:
    t = trades.filter((F.col("ts") >= hour_start) & (F.col("ts") < hour_end))
    m = bucket_metrics(t, symbol=F.col("symbol"))
    return m.select("symbol", F.col("volume").alias("volume_1h"), F.col("trades_count").alias("trades_1h"),
                    F.col("unique_traders").alias("unique_traders_1h"), F.col("avg_price").alias("avg_price_1h"),
                    F.col("low_price").alias("low_1h"), F.col("high_price").alias("high_1h"),
                    F.col("open_price").alias("open_1h"), F.col("close_price").alias("close_1h"))


METRICS = ["volume", "trades_count", "unique_traders", "avg_price", "high_price", "low_price", "open_price", "close_price"]


def trading_metrics(trades: DataFrame, interval: str) -> DataFrame:
    """Bucket x symbol metrics table (hourly or daily)."""
    return bucket_metrics(trades, bucket=bucket("ts", interval_seconds(interval)), symbol=F.col("symbol")).select(
        "bucket", "symbol", *METRICS)


def price_history(hourly: DataFrame, hours: int, as_of: int, symbol: str | None = None) -> DataFrame:
    h = _symbol(hourly.filter((F.col("bucket") >= as_of - hours * 3600) & (F.col("bucket") <= as_of)), symbol)
    return h.select("symbol", "bucket", "open_price", "high_price", "low_price", "close_price", "volume").orderBy("symbol", "bucket")


def volume_by_pool(trades: DataFrame, interval: str) -> DataFrame:
    return bucket_metrics(trades, bucket=bucket("ts", interval_seconds(interval)), pool_id=F.col("pool_id")).select(
        "bucket", "pool_id", F.col("trades_count").alias("trade_count"), "volume", "avg_trade_size",
        F.col("low_price").alias("min_price"), F.col("high_price").alias("max_price"), "open_price", "close_price")


def symbol_volume(enriched: DataFrame, interval: str = "1h") -> DataFrame:
    """Order-side trades: distinct traders and volume split by the side of the joined order."""
    return bucket_metrics(enriched, bucket=bucket("ts", interval_seconds(interval)), symbol=F.col("symbol")).select(
        "bucket", "symbol", F.col("trades_count").alias("trade_count"), "volume", "avg_trade_size", "unique_traders",
        "buy_volume", "sell_volume")


def unique_traders_hourly(enriched: DataFrame) -> DataFrame:
    return enriched.groupBy(bucket("ts", 3600).alias("bucket")).agg(
        F.count_distinct("user_id").alias("unique_traders"),
        F.count_distinct(F.when(is_buy(), F.col("user_id"))).alias("unique_buyers"),
        F.count_distinct(F.when(~is_buy(), F.col("user_id"))).alias("unique_sellers"),
        F.count(F.lit(1)).alias("total_trades"))


def trading_metrics_24h(trades: DataFrame, as_of: int) -> DataFrame:
    """Market totals of the last 24 hours; distinct traders are recounted, never summed over buckets."""
    t = trades.filter(in_period("ts", "24h", as_of))
    return t.agg(F.sum("quote_qty").alias("total_volume"), F.count(F.lit(1)).alias("total_trades"),
                 F.count_distinct("user_id").alias("unique_traders"))


def symbol_stats_24h(trades: DataFrame, as_of: int, n: int | None = None) -> DataFrame:
    m = bucket_metrics(trades.filter(in_period("ts", "24h", as_of)), symbol=F.col("symbol"))
    out = m.select("symbol", F.col("volume").alias("volume_24h"), F.col("trades_count").alias("trades_24h"),
                   F.col("unique_traders").alias("unique_traders_24h"), F.col("high_price").alias("high_24h"),
                   F.col("low_price").alias("low_24h"), F.col("avg_price").alias("avg_price_24h")).orderBy(
        F.col("volume_24h").desc(), "symbol")
    return out.limit(n) if n else out


def hourly_metrics_lookup(hourly: DataFrame, hour: int) -> DataFrame:
    return hourly.filter(F.col("bucket") == hour)


def trades_count_rollup(daily: DataFrame, trades: DataFrame, period: str, interval: str, as_of: int,
                        symbol: str | None = None) -> DataFrame:
    """Daily metrics re-bucketed; distinct traders recounted from trades."""
    d = _symbol(daily.filter(in_period("bucket", period, as_of)), symbol)
    t = _symbol(trades, symbol).withColumn("day", bucket("ts", 86400)).filter(in_period("day", period, as_of))
    rolled = d.groupBy(calendar_bucket("bucket", interval).alias("timestamp")).agg(
        F.sum("trades_count").alias("trade_count"), F.sum("volume").alias("volume"),
        F.avg(F.try_divide("volume", "trades_count")).alias("avg_trade_size"), F.max("trades_count").alias("peak_trades"))
    people = t.groupBy(calendar_bucket("day", interval).alias("timestamp")).agg(
        F.count_distinct("user_id").alias("unique_traders"))
    return rolled.join(people, "timestamp", "left")


def trade_aggregates_hourly(trades: DataFrame, since: int = 0) -> DataFrame:
    """Hourly aggregate rows from the bucket holding ``since`` on (the boundary bucket is complete)."""
    start = since - since % 3600
    return bucket_metrics(trades.filter(F.col("ts") >= start), timestamp=bucket("ts", 3600), symbol=F.col("symbol")).select(
        "timestamp", "symbol", "volume", F.col("trades_count").alias("trade_count"), "avg_price", "high_price", "low_price")


def trades_rollup(aggregates: DataFrame, interval: str) -> DataFrame:
    """Second-level rollup. The price column is an average of bucket averages and says so."""
    return aggregates.groupBy(bucket("timestamp", interval_seconds(interval)).alias("time_bucket"), "symbol").agg(
        F.sum("volume").alias("total_volume"), F.sum("trade_count").alias("total_trades"),
        F.avg("avg_price").alias("avg_of_avg_price"), F.max("high_price").alias("high_price"),
        F.min("low_price").alias("low_price"))


def mv_current_volume(trades: DataFrame, as_of: int) -> DataFrame:
    m = bucket_metrics(trades.filter(in_period("ts", "24h", as_of)), symbol=F.col("symbol"))
    return m.select("symbol", F.col("trades_count").alias("trade_count"), F.col("volume").alias("total_volume"), "avg_price",
                    "high_price", "low_price", "unique_traders", "last_trade_time")


def mv_trade_counts_24h(trades: DataFrame, as_of: int) -> DataFrame:
    m = bucket_metrics(trades.filter(in_period("ts", "24h", as_of)), trade_hour=bucket("ts", 3600), symbol=F.col("symbol"))
    return m.select("trade_hour", "symbol", F.col("trades_count").alias("trade_count"), "volume", "unique_traders", "avg_price")


def symbol_volume_series(trades: DataFrame, period: str, interval: str, as_of: int, symbols: list[str] | None = None) -> DataFrame:
    """Spine buckets x symbols that have trades. Each trade finds its bucket by arithmetic, not by a range join."""
    step = interval_seconds(interval)
    start = series_start(trades, period, as_of, step)
    t = _among(trades.filter(in_period("ts", period, as_of)), symbols)
    m = bucket_metrics(t, idx=bucket_index("ts", start, step), symbol=F.col("symbol"))
    line = spine(trades.sparkSession, start, as_of, step)
    return line.join(m, "idx").select("symbol", "timestamp", "volume", F.col("trades_count").alias("trades"),
                                      "unique_traders", "avg_trade_size")


def symbol_volume_summary(trades: DataFrame, period: str, as_of: int, symbols: list[str] | None = None) -> DataFrame:
    m = bucket_metrics(_among(trades.filter(in_period("ts", period, as_of)), symbols), symbol=F.col("symbol"))
    return m.filter(F.col("volume") > 0).select(
        "symbol", F.col("volume").alias("total_volume"), F.col("trades_count").alias("total_trades"), "unique_traders",
        "avg_trade_size", "largest_trade", "first_trade_time", "last_trade_time")


def volume_report(trades: DataFrame, period: str, interval: str, as_of: int) -> DataFrame:
    """Share of the market per symbol next to the market's average and peak bucket."""
    cells = settle(trades.filter(in_period("ts", period, as_of)).groupBy(
        "symbol", calendar_bucket("ts", interval).alias("b")).agg(F.sum("quote_qty").alias("v"), F.count(F.lit(1)).alias("n")))
    by_symbol = cells.groupBy("symbol").agg(F.sum("v").alias("volume"), F.sum("n").alias("trades"))
    series = cells.groupBy("b").agg(F.sum("v").alias("v"))
    market = series.agg(F.struct(F.sum("v").alias("total"), F.avg("v").alias("mean"), F.max("v").alias("peak")).alias("m"))
    active = by_symbol.agg(F.count(F.lit(1)))
    return by_symbol.withColumn("m", market.scalar()).select(
        "symbol", "volume", "trades", (ratio0("volume", "m.total") * 100).alias("percentage"),
        F.col("m.total").alias("total_volume"), F.col("m.mean").alias("avg_volume_per_interval"),
        F.col("m.peak").alias("peak_volume"), active.scalar().alias("active_symbols"))


def trades_report(trades: DataFrame, period: str, interval: str, as_of: int, symbol: str | None = None) -> DataFrame:
    """Totals with the average and the real peak bucket."""
    t = _symbol(trades.filter(in_period("ts", period, as_of)), symbol)
    series = t.groupBy(calendar_bucket("ts", interval).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("quote_qty").alias("v"))
    return series.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_trades"), F.coalesce(F.sum("v"), F.lit(0.0)).alias("total_volume"),
        F.coalesce(F.floor(F.try_divide(F.sum("n"), F.count(F.lit(1)))), F.lit(0)).alias("avg_trades_per_bucket"),
        F.coalesce(F.max("n"), F.lit(0)).alias("peak_trades"), F.max_by("b", F.struct(F.col("n"), -F.col("b"))).alias("peak_bucket"))
