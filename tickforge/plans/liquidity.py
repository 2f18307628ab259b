"""Liquidity metrics over current and historical books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.columns import above, at_least, is_buy, ratio, scaled, sum_if
from tickforge.functions.timeutil import bucket, in_period, period_start
from tickforge.operators.keyed import latest_per_key
from tickforge.operators.temporal import over_spans
from tickforge.plans.books import DEFAULT_SPREAD, snapshot_aggs, with_spread
from tickforge.plans.volume import _among, _symbol
from tickforge.plans.orders import POOL

# Depth bounds with their base score, rating bounds, report bounds.
DEPTH_SCORES = [(100_000, 90.0), (50_000, 70.0), (10_000, 50.0)]
RATINGS = [(80, "Excellent"), (60, "Good"), (40, "Moderate"), (20, "Low")]
REPORT_SCORES = [(10_000, 92.3), (5_000, 85.7), (1_000, 78.5)]
REPORT_RATINGS = [(10_000, "Excellent"), (5_000, "Very Good"), (1_000, "Good")]


def _dims(pools: DataFrame) -> DataFrame:
    return pools.filter(F.col("coin").isNotNull() & (F.col("coin") != "")).select(
        "chain_id", F.col("order_book").alias("pool_id"), F.col("coin").alias("symbol"), "base_decimals", "quote_decimals")


def _book_aggs() -> list[Column]:
    return [sum_if(is_buy(), "value").alias("bid_depth"), sum_if(~is_buy(), "value").alias("ask_depth"),
            F.sum(F.when(is_buy(), F.col("order_count"))).alias("bid_orders"),
            F.sum(F.when(~is_buy(), F.col("order_count"))).alias("ask_orders"),
            F.max(F.when(is_buy(), F.col("h_price"))).alias("best_bid"),
            F.min(F.when(~is_buy(), F.col("h_price"))).alias("best_ask")]


def human_levels(depth: DataFrame, pools: DataFrame) -> DataFrame:
    """Levels with human price and quote value."""
    return depth.join(_dims(pools), POOL).withColumn("h_price", scaled("price", "quote_decimals")).withColumn(
        "value", scaled("quantity", "base_decimals") * F.col("h_price"))


def liquidity_now(pools: DataFrame, depth: DataFrame, period: str, as_of: int) -> DataFrame:
    """Depth, order counts and best prices per symbol; the freshness filter keeps symbols with empty books."""
    fresh = depth.filter((F.col("last_updated") >= period_start(period, as_of)) & (F.col("order_count") > 0))
    book = human_levels(fresh, pools).groupBy(*POOL).agg(*_book_aggs())
    z = lambda c, v: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return _dims(pools).select(*POOL, "symbol").join(book, POOL, "left").select(
        "symbol", *POOL, z("bid_depth", 0.0), z("ask_depth", 0.0), z("bid_orders", 0), z("ask_orders", 0),
        z("best_bid", 0.0), "best_ask").orderBy((F.col("bid_depth") + F.col("ask_depth")).desc(), "symbol", "chain_id")


def symbol_liquidity_summary(pools: DataFrame, depth: DataFrame, trades: DataFrame, period: str, as_of: int,
                             symbols: list[str] | None = None) -> DataFrame:
    """Full-book depth and spread with the period's trade statistics. ``trades.symbol`` is the pool's order book."""
    book = human_levels(depth.filter(F.col("quantity") > 0), pools).groupBy(*POOL, "symbol").agg(*_book_aggs())
    recent = trades.filter(in_period("ts", period, as_of)).groupBy("chain_id", F.col("symbol").alias("pool_id")).agg(
        F.count(F.lit(1)).alias("recent_trades"), F.avg("quote_qty").alias("avg_trade_volume"),
        F.min("ts").alias("first_trade_time"), F.max("ts").alias("last_trade_time"))
    both = (F.col("best_bid") > 0) & (F.col("best_ask") > 0)
    return _among(book.join(recent, POOL, "left"), symbols).select(
        "symbol", *POOL, "bid_depth", "ask_depth", (F.col("bid_depth") + F.col("ask_depth")).alias("total_depth"),
        F.coalesce("bid_orders", F.lit(0)).alias("bid_orders"), F.coalesce("ask_orders", F.lit(0)).alias("ask_orders"),
        "best_bid", "best_ask",
        F.when(both, (F.col("best_ask") - F.col("best_bid")) / F.col("best_bid") * 100).otherwise(0.0).alias("spread_percentage"),
        F.coalesce("recent_trades", F.lit(0)).alias("recent_trades"),
        F.coalesce("avg_trade_volume", F.lit(0.0)).alias("avg_trade_volume"), "first_trade_time", "last_trade_time")


def liquidity_metrics(levels: DataFrame, pools: DataFrame, trades: DataFrame, step: int = 60, window: int = 300) -> DataFrame:
    """Depth, spread, score and rating per symbol and snapshot, with the trades of the ``window`` before it.

    ``levels`` carries snapshot_ts at multiples of ``step``.
    """
    book = human_levels(levels.filter(F.col("quantity") > 0), pools).groupBy("snapshot_ts", *POOL, "symbol").agg(*_book_aggs())
    return _rated(book, trades, step, window)


def liquidity_metrics_of_spans(spans: DataFrame, pools: DataFrame, trades: DataFrame, step: int = 3600, window: int = 300) -> DataFrame:
    """``liquidity_metrics`` at the end of every step of a book that is given as ``books.book_spans``.

    Spans, not the levels of every step, meet the pools: levels multiply behind a size that Spark knows, and it may then
    take them for the side to broadcast.
    """
    sums = [F.sum(c).alias(c) for c in ("bid_depth", "ask_depth", "bid_orders", "ask_orders")]
    book = over_spans(human_levels(spans, pools), [*POOL, "symbol"], "from", "to", "hour", _book_aggs(),
                      [*sums, F.max("best_bid").alias("best_bid"), F.min("best_ask").alias("best_ask")], step)
    return _rated(book.withColumn("snapshot_ts", F.col("hour") + step).drop("hour"), trades, step, window)


def _rated(book: DataFrame, trades: DataFrame, step: int, window: int) -> DataFrame:
    """Each trade names the snapshots whose window holds it, so trades, summed per second, meet snapshots by equality."""
    per_second = trades.groupBy("chain_id", F.col("symbol").alias("pool_id"), "ts").agg(
        F.sum("quote_qty").alias("quote"), F.count(F.lit(1)).alias("n"))
    first = F.ceil(F.col("ts") / step) * step
    upto = F.col("ts") + window
    seen = per_second.filter(first <= upto).select(
        *POOL, "quote", "n", F.explode(F.sequence(first, upto, F.lit(step).cast("long"))).alias("snapshot_ts"))
    recent = seen.groupBy(*POOL, "snapshot_ts").agg(
        F.sum("n").alias("recent_trades"), (F.sum("quote") / F.sum("n")).alias("avg_trade_volume"))
    total = F.col("bid_depth") + F.col("ask_depth")
    spread = ratio(F.col("best_ask") - F.col("best_bid"), "best_bid")
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), above(total, DEPTH_SCORES, 30.0) - F.coalesce(spread * 1000, F.lit(0.0))))
    return book.join(recent, [*POOL, "snapshot_ts"], "left").withColumn("liquidity_score", score).select(
        "chain_id", "symbol", "snapshot_ts", "bid_depth", "ask_depth", total.alias("total_depth"), "best_bid", "best_ask",
        F.coalesce(F.when((F.col("best_bid") > 0) & (F.col("best_ask") > 0), spread * 10000), F.lit(0.0)).alias("spread_bps"),
        F.coalesce("bid_orders", F.lit(0)).alias("bid_orders"), F.coalesce("ask_orders", F.lit(0)).alias("ask_orders"),
        "liquidity_score", at_least("liquidity_score", RATINGS, "Very Low").alias("liquidity_rating"),
        F.coalesce("recent_trades", F.lit(0)).alias("recent_trades"),
        F.coalesce("avg_trade_volume", F.lit(0.0)).alias("avg_trade_volume"))


def _averages() -> list[Column]:
    return [F.avg("bid_depth").alias("avg_bid_depth"), F.avg("ask_depth").alias("avg_ask_depth"),
            F.avg("total_depth").alias("avg_total_depth"), F.avg("spread_bps").alias("avg_spread_bps"),
            F.avg("liquidity_score").alias("avg_liquidity_score"), F.count(F.lit(1)).alias("data_points")]


def liquidity_metrics_hourly(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("chain_id", "symbol", bucket("snapshot_ts", 3600).alias("hour")).agg(*_averages())


def liquidity_list(metrics: DataFrame, timeframe: str, as_of: int, limit: int = 100, symbols: list[str] | None = None) -> DataFrame:
    m = _among(metrics.filter(in_period("snapshot_ts", timeframe, as_of)), symbols)
    return m.orderBy("symbol", F.col("snapshot_ts").desc(), "chain_id").limit(limit)


def liquidity_latest(metrics: DataFrame, symbols: list[str] | None = None) -> DataFrame:
    return latest_per_key(_among(metrics, symbols), ["chain_id", "symbol"], "snapshot_ts")


def liquidity_trends(metrics: DataFrame, hours: int, interval: str, as_of: int, symbol: str | None = None) -> DataFrame:
    step = {"5m": 300, "15m": 900}.get(interval, 3600)
    m = _symbol(metrics.filter(F.col("snapshot_ts").between(as_of - hours * 3600, as_of)), symbol)
    return m.groupBy("chain_id", "symbol", bucket("snapshot_ts", step).alias("time_bucket")).agg(
        *_averages(), F.max("snapshot_ts").alias("latest_time"))


def value_history(history: DataFrame, pools: DataFrame, step: int = 3600) -> DataFrame:
    """Hourly book levels valued in quote units, stamped with the hour's end."""
    return human_levels(history, pools).select(
        (F.col("hour") + step).alias("snapshot_ts"), *POOL, "symbol", "side", F.col("h_price").alias("price"), "quantity",
        "order_count", F.col("value").alias("liquidity_value"))


def value_history_aggregate(spans: DataFrame, pools: DataFrame, step: int = 3600) -> DataFrame:
    """``books.book_snapshot_aggregate`` of the ``value_history`` of a book that is given as ``books.book_spans``."""
    valued = human_levels(spans, pools).drop("price").withColumnsRenamed({"h_price": "price", "value": "liquidity_value"})
    sums = [F.sum(c).alias(c) for c in ("bid_liquidity", "ask_liquidity", "total_liquidity", "bid_orders", "ask_orders")]
    per_hour = over_spans(valued, [*POOL, "symbol"], "from", "to", "hour", snapshot_aggs(),
                          [*sums, F.max("best_bid").alias("best_bid"), F.min("best_ask").alias("best_ask")], step)
    cols = ["snapshot_ts", *POOL, "symbol", "bid_liquidity", "ask_liquidity", "total_liquidity", "bid_orders", "ask_orders", "best_bid", "best_ask"]
    return with_spread(per_hour.withColumn("snapshot_ts", F.col("hour") + step).select(*cols))


def liquidity_over_time(aggregated: DataFrame, period: str, as_of: int, symbol: str | None = None) -> DataFrame:
    a = _symbol(aggregated.filter(in_period("snapshot_ts", period, as_of)), symbol)
    return a.groupBy("snapshot_ts").agg(
        F.sum("bid_liquidity").alias("bid_liquidity"), F.sum("ask_liquidity").alias("ask_liquidity"),
        F.sum("total_liquidity").alias("total_liquidity"), F.count_distinct("symbol").alias("active_markets"),
        F.avg("spread").alias("average_spread"))


def liquidity_latest_snapshot(aggregated: DataFrame, symbol: str | None = None) -> DataFrame:
    """Market totals of the newest snapshot."""
    a = _symbol(aggregated, symbol)
    newest = a.agg(F.max("snapshot_ts")).scalar()
    return a.filter(F.col("snapshot_ts") == newest).groupBy("snapshot_ts").agg(
        F.sum("bid_liquidity").alias("bid_liquidity"), F.sum("ask_liquidity").alias("ask_liquidity"), F.avg("spread").alias("spread"))


def liquidity_breakdown(aggregated: DataFrame, period: str, as_of: int) -> DataFrame:
    """Newest snapshot per symbol inside the period."""
    return latest_per_key(aggregated.filter(in_period("snapshot_ts", period, as_of)), ["chain_id", "symbol"], "snapshot_ts")


def liquidity_report(aggregated: DataFrame, period: str, as_of: int) -> DataFrame:
    """One row: totals, score and rating, depth and spread classes, the three deepest and tightest symbols."""
    last = liquidity_latest_snapshot(aggregated).select(
        F.struct("bid_liquidity", "ask_liquidity", "spread").alias("t")).scalar()
    b = liquidity_breakdown(aggregated, period, as_of)
    deepest = b.orderBy(F.col("total_liquidity").desc(), "symbol", "chain_id").limit(3).agg(F.array_sort(F.collect_list("symbol"))).scalar()
    tightest = b.filter("spread < 1").orderBy("spread", "symbol", "chain_id").limit(3).agg(F.array_sort(F.collect_list("symbol"))).scalar()
    total, spread = F.col("total_liquidity"), F.coalesce("spread", F.lit(DEFAULT_SPREAD))
    classes = b.agg(
        F.count(F.lit(1)).alias("active_markets"), F.count(F.when(total > 2000, 1)).alias("deep"),
        F.count(F.when((total > 500) & (total <= 2000), 1)).alias("moderate_depth"), F.count(F.when(total <= 500, 1)).alias("shallow"),
        F.count(F.when(spread < 0.005, 1)).alias("tight"), F.count(F.when((spread >= 0.005) & (spread <= 0.02), 1)).alias("moderate_spread"),
        F.count(F.when(spread > 0.02, 1)).alias("wide"))
    return classes.withColumn("t", last).withColumn("all", F.col("t.bid_liquidity") + F.col("t.ask_liquidity")).select(
        F.col("t.bid_liquidity").alias("bid_liquidity"), F.col("t.ask_liquidity").alias("ask_liquidity"),
        F.col("all").alias("total_liquidity"), (F.coalesce("t.spread", F.lit(DEFAULT_SPREAD)) * 100).alias("average_spread_percent"),
        above("all", REPORT_SCORES, 65.2).alias("liquidity_score"), above("all", REPORT_RATINGS, "Fair").alias("liquidity_rating"),
        "active_markets", "deep", "moderate_depth", "shallow", "tight", "moderate_spread", "wide",
        deepest.alias("most_liquid"), tightest.alias("tightest_spreads"))
