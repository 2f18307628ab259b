"""Slippage against the book mid price and against nearby trades."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import below, is_buy, ratio0
from tickforge.functions.timeutil import bucket, bucket_index, in_period, interval_seconds, period_start, series_start, spine
from tickforge.operators.keyed import latest_per_key
from tickforge.operators.ranking import group_median
from tickforge.operators.temporal import asof_join, range_mean
from tickforge.plans.volume import _among, _symbol
from tickforge.session import settle

# Upper bounds of the trade-size classes and of the quality and score bands.
SIZE_CLASSES = [(1000, "small"), (10000, "medium"), (100000, "large")]
SIZE_BANDS = {"small": (0.0, 1000.0), "medium": (1000.0, 10000.0), "large": (10000.0, None)}
QUALITY = [(0.1, "excellent"), (0.5, "good"), (1.0, "fair")]
SCORES = [(0.2, 95), (0.5, 85), (1.0, 70)]


def size_class(value: str | Column = "quote_qty") -> Column:
    return below(value, SIZE_CLASSES, "whale")


def trade_size_filter(trades: DataFrame, size: str | None) -> DataFrame:
    """Half-open size bands, so a trade of exactly 1000 is medium and belongs to one band only."""
    if size not in SIZE_BANDS:
        return trades
    return trades.filter(_in_band(size))


def _in_band(size: str) -> Column:
    low, high = SIZE_BANDS[size]
    over = F.col("quote_qty") >= low
    return over if high is None else over & (F.col("quote_qty") < high)


def mid_price_asof(trades: DataFrame, snapshots: DataFrame, tolerance: int = 30) -> DataFrame:
    """Mid of the newest book snapshot at or before each trade, null when older than ``tolerance``."""
    return asof_join(trades, snapshots.select("symbol", "ts", "seq", "best_bid", "best_ask"), ["symbol"], "ts",
                     ["best_bid", "best_ask"], "seq", tolerance).withColumn(
        "mid_price", F.when(F.col("matched_ts").isNotNull(),
                            (F.coalesce("best_bid", F.lit(0.0)) + F.coalesce("best_ask", F.lit(0.0))) / 2)
    ).drop("best_bid", "best_ask")


def mid_price_window(trades: DataFrame, radius: int = 60) -> DataFrame:
    """Mean price of the symbol's trades within ``radius`` seconds around each trade."""
    return range_mean(trades, ["symbol"], "ts", "price", radius, "mid_price", max(3600, 4 * radius))


def slippage_bps(trades: DataFrame, snapshots: DataFrame, tolerance: int = 30) -> DataFrame:
    """Absolute distance from the mid in basis points (0 without a mid), kept to 6 places."""
    t = mid_price_asof(trades, snapshots, tolerance)
    mid = F.col("mid_price")
    return t.withColumn("slippage_bps", F.round(
        F.when(mid > 0, F.abs((F.col("price") - mid) / mid * 10000)).otherwise(0.0), 6))


def slippage_hourly(trades: DataFrame, snapshots: DataFrame, tolerance: int = 30, min_trades: int = 3) -> DataFrame:
    """Slippage statistics per symbol, hour (stamped with its end) and size class with enough trades."""
    keys = ["symbol", "time_bucket", "trade_size_category"]
    t = slippage_bps(trades, snapshots, tolerance).withColumn("time_bucket", bucket("ts", 3600) + 3600).withColumn(
        "trade_size_category", size_class())
    q, x, n = F.col("quote_qty"), F.col("slippage_bps"), F.col("n")
    cells = settle(t.groupBy(*keys, "slippage_bps").agg(
        F.count(F.lit(1)).alias("n"), F.sum("quote_qty").alias("sq"), F.sum(q * q).alias("sqq")))
    s = cells.groupBy(*keys).agg(
        F.sum("n").alias("trades_count"), F.sum("sq").alias("total_volume"), F.sum("sqq").alias("qq"), F.sum(x * n).alias("sx"),
        F.sum(x * x * n).alias("xx"), F.sum(x * F.col("sq")).alias("xq"), F.max(x).alias("max_slippage_bps"),
        F.min(x).alias("min_slippage_bps")).filter(F.col("trades_count") >= min_trades)
    mean_q, mean_x = F.col("total_volume") / F.col("trades_count"), F.col("sx") / F.col("trades_count")
    var_q, var_x = F.col("qq") / F.col("trades_count") - mean_q * mean_q, F.col("xx") / F.col("trades_count") - mean_x * mean_x
    corr = (F.col("xq") / F.col("trades_count") - mean_q * mean_x) / F.sqrt(var_q * var_x)
    stats = s.select(*keys, "trades_count", "total_volume", mean_q.alias("avg_trade_size"), mean_x.alias("avg_slippage_bps"),
                     "max_slippage_bps", "min_slippage_bps",
                     F.when((var_q > 1e-6) & (var_x > 1e-6), corr).alias("price_impact_correlation"))
    return stats.join(group_median(cells, keys, "slippage_bps", "median_slippage_bps", "n"), keys)


def _sized(rows: DataFrame, symbols: list[str] | None, size: str | None) -> DataFrame:
    r = _among(rows, symbols)
    return r if size is None else r.filter(F.col("trade_size_category") == size)


def slippage_latest(rows: DataFrame, symbols: list[str] | None = None, size: str | None = None) -> DataFrame:
    return latest_per_key(_sized(rows, symbols, size), ["symbol", "trade_size_category"], "time_bucket")


def slippage_trends(rows: DataFrame, hours: int, as_of: int, size: str | None = None) -> DataFrame:
    """Direction against the previous stored bucket, with a 10 percent dead band."""
    w = Window.partitionBy("symbol", "trade_size_category").orderBy("time_bucket")
    r = _sized(rows.filter(F.col("time_bucket").between(as_of - hours * 3600, as_of)), None, size)
    cur, prev = F.col("avg_slippage_bps"), F.col("prev")
    return r.withColumn("prev", F.lag("avg_slippage_bps").over(w)).select(
        "symbol", "time_bucket", "trade_size_category", "avg_slippage_bps", "trades_count",
        F.when(prev.isNull(), "neutral").when(cur > prev * 1.1, "increasing").when(cur < prev * 0.9, "decreasing")
        .otherwise("stable").alias("trend_direction"))


def slippage_list(rows: DataFrame, hours: int, as_of: int, limit: int = 100, symbols: list[str] | None = None,
                  size: str | None = None) -> DataFrame:
    r = _sized(rows.filter(F.col("time_bucket").between(as_of - hours * 3600, as_of)), symbols, size)
    return r.orderBy(F.col("time_bucket").desc(), "symbol", "trade_size_category").limit(limit)


def _percent(trades: DataFrame) -> DataFrame:
    """Distance from the mid in percent; trades without a positive mid have no slippage and are left out."""
    mid = F.col("mid_price")
    return trades.filter(mid > 0).withColumn("slip", F.round(F.abs(F.col("price") - mid) / mid * 100, 6))


def _cells(t: DataFrame, keys: list[str], value: str = "slip") -> DataFrame:
    """Equal values of ``value`` per key, counted and summed."""
    return t.groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("n"), F.sum("quote_qty").alias("q"), F.min("quote_qty").alias("q_min"),
        F.max("quote_qty").alias("q_max"), F.count(F.when(is_buy(), 1)).alias("buys"), F.min("ts").alias("t_min"), F.max("ts").alias("t_max"))


def _merged(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of the same value and key as one."""
    return cells.groupBy(*keys, "slip").agg(
        *[F.sum(c).alias(c) for c in ("n", "q")], F.min("q_min").alias("q_min"), F.max("q_max").alias("q_max"), F.sum("buys").alias("buys"),
        F.min("t_min").alias("t_min"), F.max("t_max").alias("t_max"))


def _stats(t: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics of ``slip`` per key. Equal values collapse first."""
    return _cell_stats(_cells(t, keys), keys)


def _cell_stats(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Statistics from counted values; that frame feeds both the sums and the median."""
    x, n = F.col("slip"), F.col("n")
    cells = settle(cells)
    s = cells.groupBy(*keys).agg(
        F.sum(x * n).alias("sx"), F.sum(x * x * n).alias("xx"), F.max("slip").alias("max_slippage"), F.sum("n").alias("trade_count"),
        F.sum(F.when(x > 1.0, n).otherwise(F.lit(0))).alias("impacted_trades"), (F.sum("q") / F.sum("n")).alias("avg_trade_value"),
        F.min("q_min").alias("min_trade_value"), F.max("q_max").alias("max_trade_value"), F.sum("buys").alias("buy_trades"),
        F.min("t_min").alias("first_trade_time"), F.max("t_max").alias("last_trade_time"))
    c = F.col("trade_count")
    mean = F.col("sx") / c
    var = F.greatest(F.try_divide(F.col("xx") - c * mean * mean, c - 1), F.lit(0.0))
    s = s.withColumn("avg_slippage", mean).withColumn("slippage_std_dev", F.when(c > 1, F.sqrt(var))).withColumn(
        "sell_trades", c - F.col("buy_trades")).drop("sx", "xx")
    return s.join(group_median(cells, keys, "slip", "median_slippage", "n"), keys).withColumn(
        "impact_rate", ratio0("impacted_trades", "trade_count") * 100).withColumn(
        "slippage_quality", below("avg_slippage", QUALITY, "poor")).withColumn(
        "liquidity_score", below("avg_slippage", SCORES, 50))


def slippage_series(trades: DataFrame, period: str, interval: str, as_of: int, radius: int = 60, symbol: str | None = None,
                    size: str | None = None) -> DataFrame:
    """Gap-filled series of slippage against nearby trades; buckets without trades report zeros."""
    return slippage_series_by_size(trades, period, interval, as_of, [size], radius, symbol).drop("size")


def slippage_series_by_size(trades: DataFrame, period: str, interval: str, as_of: int, sizes: Sequence[str | None], radius: int = 60,
                            symbol: str | None = None) -> DataFrame:
    """``slippage_series`` of every size, with ``size`` in front; the mid prices are found once for all of them.

    Bands that lie inside each other are merged from counted values, no trade is copied per size.
    """
    step = interval_seconds(interval)
    start = series_start(trades, period, as_of, step)
    t = _percent(mid_price_window(_symbol(trades.filter(in_period("ts", period, as_of)), symbol), radius))
    t = t.withColumn("idx", bucket_index("ts", start, step))
    member = lambda size: F.lit(True) if size not in SIZE_BANDS else _in_band(size)
    bands = F.array_compact(F.array(*[F.when(member(size), F.lit(n)) for n, size in enumerate(sizes)]))
    cells = _cells(t.withColumn("bands", bands), ["idx", "bands"]).withColumn("band", F.explode("bands")).drop("bands")
    s = _cell_stats(_merged(cells, ["band", "idx"]), ["band", "idx"])
    z = lambda c, v=0.0: F.coalesce(F.col(c), F.lit(v)).alias(c)
    line = spine(trades.sparkSession, start, as_of, step).withColumn("band", F.explode(F.array(*[F.lit(n) for n in range(len(sizes))])))
    name = F.element_at(F.array(*[F.lit(size).cast("string") for size in sizes]), F.col("band") + 1)
    return line.join(s, ["band", "idx"], "left").select(
        name.alias("size"), "timestamp", z("avg_slippage"), z("median_slippage"), z("max_slippage"), z("slippage_std_dev"),
        z("trade_count", 0), z("impacted_trades", 0), z("impact_rate"))


def symbol_slippage_series(trades: DataFrame, period: str, interval: str, as_of: int, radius: int = 60,
                           symbols: list[str] | None = None, size: str | None = None) -> DataFrame:
    start, step = period_start(period, as_of), interval_seconds(interval)
    t = _percent(mid_price_window(_among(trades.filter(in_period("ts", period, as_of)), symbols), radius))
    t = trade_size_filter(t, size).withColumn("idx", bucket_index("ts", start, step))
    return _stats(t, ["symbol", "idx"]).select(
        "symbol", (F.lit(start).cast("long") + F.col("idx") * step).alias("timestamp"), "avg_slippage", "median_slippage",
        "max_slippage", F.coalesce("slippage_std_dev", F.lit(0.0)).alias("slippage_std_dev"), "trade_count", "impacted_trades",
        "impact_rate", "avg_trade_value", "buy_trades", "sell_trades", "slippage_quality")


def slippage_overall(trades: DataFrame, period: str, as_of: int, symbol: str | None = None, size: str | None = None) -> DataFrame:
    """One row: slippage against the period's market-wide mean price, with quality and score."""
    t = trades.filter(in_period("ts", period, as_of))
    mean = t.agg(F.avg("price")).scalar()
    p = _percent(trade_size_filter(_symbol(t, symbol), size).withColumn("mid_price", mean)).withColumn("all", F.lit("all"))
    return _stats(p, ["all"]).select("avg_slippage", "median_slippage", "slippage_quality", "impact_rate", "liquidity_score")


def symbol_slippage_summary(trades: DataFrame, period: str, as_of: int, symbols: list[str] | None = None,
                            size: str | None = None) -> DataFrame:
    """Per symbol against the symbol's own mean price of the period.

    Trades are counted per symbol and price first; only these counts meet their symbol's mean, dealt out with a salt, so that
    no task has all trades or all prices of a symbol.
    """
    t = _among(trades.filter(in_period("ts", period, as_of)), symbols)
    taken = _in_band(size) if size in SIZE_BANDS else F.lit(True)
    prices = settle(_cells(t.withColumn("taken", taken), ["symbol", "taken"], "price"))
    price, n = F.col("price"), F.col("n")
    salts = int(trades.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mean = prices.groupBy("symbol").agg((F.sum(price * n) / F.sum(F.when(price.isNotNull(), n))).alias("mid_price")).withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    met = prices.filter("taken").withColumn("salt", F.pmod(F.xxhash64("price"), F.lit(salts)).cast("int")).join(mean, ["symbol", "salt"])
    return _cell_stats(_merged(_percent(met), ["symbol"]), ["symbol"])


def slippage_by_symbol_nested(series: DataFrame, summary: DataFrame) -> DataFrame:
    """One row per symbol: its summary and the ordered array of series points (bounded by the bucket count)."""
    points = series.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct(
        "timestamp", "avg_slippage", "trade_count", "impact_rate"))).alias("points"))
    return summary.join(points, "symbol", "left").orderBy("avg_slippage", "symbol")
