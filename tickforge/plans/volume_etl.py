"""Multi-interval volume time series with moving averages, trend, volatility and size counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import is_buy, ratio, ratio0, sum_if, time_order
from tickforge.functions.timeutil import FIRST_MONDAY, bucket
from tickforge.plans.volume import _among
from tickforge.session import settle

VOLUME_INTERVALS = {"5m": 300, "15m": 900, "1h": 3600, "4h": 14400, "1d": 86400}
LARGE, WHALE = 3.0, 10.0  # fixed values: multiples of the bucket's mean trade


def origin_of(step: int) -> int:
    """Weeks begin on Monday, everything else at the epoch."""
    return FIRST_MONDAY if step % 604800 == 0 else 0


def bucket_end(at: Column, step: int) -> Column:
    return bucket(at, step, origin_of(step)) + step


def per_interval(cells: DataFrame, at: str, intervals: dict[str, int]) -> DataFrame:
    """Every cell (a partial aggregate stamped with its start ``at``) once per interval, with the end of its bucket."""
    steps = F.array(*[F.struct(F.lit(n).alias("interval_type"), F.lit(s).cast("long").alias("step"),
                               bucket_end(F.col(at), s).alias("time_bucket")) for n, s in intervals.items()])
    return cells.withColumn("i", F.explode(steps)).select("*", "i.interval_type", "i.step", "i.time_bucket").drop("i")


def base_step(intervals: dict[str, int]) -> int:
    """The widest cell that every interval is made of."""
    return math.gcd(*intervals.values())


def _cells(trades: DataFrame, step: int) -> DataFrame:
    """Sums and moments per (symbol, cell): the one frame that all intervals are merged from."""
    order = time_order(trades)
    return trades.groupBy("symbol", bucket("ts", step).alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("quote_qty").alias("volume"), sum_if(is_buy(), "quote_qty").alias("buy_volume"),
        sum_if(~is_buy(), "quote_qty").alias("sell_volume"), F.count(F.when(is_buy(), 1)).alias("buy_trades"), F.sum("quantity").alias("qty"),
        F.min_by("price", order).alias("open_price"), F.max("price").alias("high_price"), F.min("price").alias("low_price"),
        F.max_by("price", order).alias("close_price"), F.avg("price").alias("mean"), (F.var_pop("price") * F.count(F.lit(1))).alias("m2"))


def _traders(trades: DataFrame, step: int, intervals: dict[str, int]) -> DataFrame:
    """Distinct traders per (symbol, interval, bucket).

    A trader's cells are gathered per widest interval, which bounds the set, and only the distinct buckets of every
    interval are counted.
    """
    widest = max(intervals.values())
    sets = trades.groupBy("symbol", "user_id", bucket("ts", widest, origin_of(widest)).alias("span")).agg(
        F.collect_set(bucket("ts", step)).alias("cells"))

    def hits(name: str, s: int) -> Column:
        buckets = F.array_distinct(F.transform("cells", lambda c: bucket_end(c, s)))
        return F.transform(buckets, lambda b: F.struct(F.lit(name).alias("interval_type"), b.alias("time_bucket")))
    return sets.select("symbol", F.explode(F.concat(*[hits(n, s) for n, s in intervals.items()])).alias("h")).groupBy("symbol", "h.interval_type", "h.time_bucket").agg(
        F.count(F.lit(1)).alias("unique_traders"))


def _large(trades: DataFrame, cells: DataFrame, step: int, intervals: dict[str, int]) -> DataFrame:
    """Large and whale trades per (symbol, interval, bucket).

    Equal sizes of a cell are counted once and meet the mean sizes of all buckets that hold the cell in one row, so the
    sizes are compared where they lie and only counts are merged upwards.
    """
    means = cells
    for n, s in intervals.items():
        w = Window.partitionBy("symbol", bucket_end(F.col("cell"), s))
        means = means.withColumn(f"mean_{n}", F.sum("volume").over(w) / F.sum("n").over(w))
    sizes = trades.groupBy("symbol", bucket("ts", step).alias("cell"), "quote_qty").agg(F.count(F.lit(1)).alias("n"))
    over = lambda n, times: sum_if(F.col("quote_qty") > F.col(f"mean_{n}") * times, "n")
    counts = sizes.join(means.select("symbol", "cell", *[f"mean_{n}" for n in intervals]), ["symbol", "cell"]).groupBy("symbol", "cell").agg(
        *[F.struct(over(n, LARGE).alias("large"), over(n, WHALE).alias("whale")).alias(f"c_{n}") for n in intervals])
    rows = F.array(*[F.struct(F.lit(n).alias("interval_type"), bucket_end(F.col("cell"), s).alias("time_bucket"),
                              F.col(f"c_{n}").alias("c")) for n, s in intervals.items()])
    return counts.select("symbol", F.explode(rows).alias("r")).groupBy("symbol", "r.interval_type", "r.time_bucket").agg(
        F.sum("r.c.large").alias("large_trade_count"), F.sum("r.c.whale").alias("whale_trade_count"))


def volume_timeseries(trades: DataFrame, intervals: dict[str, int] | None = None) -> DataFrame:
    """One row per symbol, interval and bucket (stamped with the bucket end).

    Trades are reduced to cells of the base step; sums, moments, distinct traders and size counts of every interval are
    merged from cells, never from trades. The history columns are windows over the finished series.
    """
    keys = ["symbol", "interval_type", "time_bucket"]
    intervals = intervals or VOLUME_INTERVALS
    step = base_step(intervals)
    cells = settle(_cells(trades, step))
    n, mean = F.col("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    m2 = F.greatest(F.sum("m2") + F.sum(n * F.col("mean") * F.col("mean")) - F.sum("n") * mean * mean, F.lit(0.0))
    stats = per_interval(cells, "cell", intervals).groupBy(*keys).agg(
        F.sum("n").alias("trades_count"), F.sum("volume").alias("volume"), F.sum("buy_volume").alias("buy_volume"),
        F.sum("sell_volume").alias("sell_volume"), F.sum("buy_trades").alias("buy_trades"),
        (F.sum("n") - F.sum("buy_trades")).alias("sell_trades"), F.sum("qty").alias("qty"),
        F.min_by("open_price", "cell").alias("open_price"), F.max("high_price").alias("high_price"),
        F.min("low_price").alias("low_price"), F.max_by("close_price", "cell").alias("close_price"),
        F.when(F.sum("n") > 1, F.sqrt(m2 / (F.sum("n") - 1))).alias("price_stddev"))
    series = stats.join(_traders(trades, step, intervals), keys).join(_large(trades, cells, step, intervals), keys)
    peers = Window.partitionBy("interval_type", "time_bucket")
    w = Window.partitionBy("symbol", "interval_type").orderBy("time_bucket")
    series = (
        series.withColumn("market_volume", F.sum("volume").over(peers))
        .withColumn("vwap", ratio(F.col("volume"), "qty"))
        .withColumn("sma", F.avg("volume").over(w.rowsBetween(-19, -1)))
        .withColumn("prev", F.lag("volume", 1).over(w)).withColumn("prev5", F.lag("volume", 5).over(w))
    )
    swing = F.try_divide(F.col("volume") - F.col("prev"), F.col("prev")) * 50
    return series.select(
        *keys, "volume", "trades_count", "unique_traders", "buy_volume", "sell_volume", "buy_trades", "sell_trades",
        F.col("vwap").alias("volume_weighted_price"), "open_price", "high_price", "low_price", "close_price",
        (F.col("close_price") - F.col("open_price")).alias("price_change"),
        F.when(F.col("open_price") > 0, (F.col("close_price") - F.col("open_price")) / F.col("open_price") * 100)
        .otherwise(0.0).alias("price_change_percent"),
        F.coalesce("sma", "volume").alias("volume_sma_20"),
        F.when(F.col("prev") > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + swing))).otherwise(50.0).alias("volume_rsi"),
        F.when(F.col("prev5").isNull(), "neutral").when(F.col("volume") > F.col("prev5") * 1.2, "increasing")
        .when(F.col("volume") < F.col("prev5") * 0.8, "decreasing").otherwise("neutral").alias("volume_trend"),
        F.when(F.col("vwap") > 0, F.coalesce(F.col("price_stddev") / F.col("vwap"), F.lit(0.0))).otherwise(0.0).alias("volatility"),
        "large_trade_count", "whale_trade_count", (ratio0("volume", "market_volume") * 100).alias("market_dominance"))


def volume_metrics(series: DataFrame, interval: str, hours: int, as_of: int, symbols: list[str] | None = None) -> DataFrame:
    s = _recent(series, interval, hours, as_of, symbols)
    return s.select("symbol", "time_bucket", "volume", "trades_count", "volume_trend", "price_change_percent",
                    "market_dominance").orderBy(F.col("time_bucket").desc(), F.col("volume").desc(), "symbol")


def _recent(series: DataFrame, interval: str, hours: int, as_of: int, symbols: list[str] | None = None) -> DataFrame:
    s = series.filter((F.col("interval_type") == interval) & (F.col("time_bucket") >= as_of - hours * 3600)
                      & (F.col("time_bucket") <= as_of))
    return _among(s, symbols)


def top_volume_symbols(series: DataFrame, interval: str, days: int, as_of: int, limit: int = 20) -> DataFrame:
    return _recent(series, interval, days * 24, as_of).groupBy("symbol").agg(
        F.sum("volume").alias("total_volume"), F.avg("volume").alias("avg_volume"), F.sum("trades_count").alias("total_trades"),
        F.avg("price_change_percent").alias("avg_price_change"), F.mode("volume_trend", True).alias("volume_trend"),
    ).orderBy(F.col("total_volume").desc(), "symbol").limit(limit)


def volume_anomalies(series: DataFrame, interval: str, hours: int, as_of: int, threshold: float = 3.0) -> DataFrame:
    s = _recent(series, interval, hours, as_of).filter(F.col("volume_sma_20") > 0)
    spike = F.col("volume") / F.col("volume_sma_20")
    return s.filter(spike >= threshold).select(
        "symbol", "time_bucket", "volume", "volume_sma_20", spike.alias("volume_spike_ratio"), "whale_trade_count").orderBy(
        F.col("volume_spike_ratio").desc(), "symbol", "time_bucket")


def volume_list(series: DataFrame, interval: str, hours: int, as_of: int, limit: int = 100,
                symbols: list[str] | None = None) -> DataFrame:
    return _recent(series, interval, hours, as_of, symbols).orderBy(
        F.col("time_bucket").desc(), F.col("volume").desc(), "symbol").limit(limit)
