"""Average-cost positions and PnL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.columns import is_buy, ratio, ratio0, time_order
from tickforge.functions.timeutil import bucket, calendar_bucket, in_period
from tickforge.operators.affine import ROWS, compose_steps
from tickforge.operators.keyed import insert_ignore
from tickforge.operators.temporal import asof_join, asof_lookup, running_sums
from tickforge.plans.orders import POOL

FILLED_STATUSES = ["FILLED", "PARTIALLY_FILLED"]
POSITION = ["chain_id", "user_id", "symbol", "quantity", "avg_cost", "total_cost", "realized_pnl", "updated_at"]


def trade_user_asof(trades: DataFrame, orders: DataFrame) -> DataFrame:
    """Attribute a fill to the newest order of its pool and side at or before it; unmatched fills are dropped.

    For logs without order ids on fills; with order ids use trades_enriched.
    """
    owners = orders.filter(F.col("user_id").isNotNull()).select(
        *POOL, "side", F.col("placed_at").alias("ts"), "seq", F.col("user_id").alias("owner"))
    return asof_join(trades, owners, [*POOL, "side"], "ts", ["owner"], "seq").filter(
        F.col("owner").isNotNull()).drop("matched_ts")


def _when(cases: list[tuple[Column, Column]], default: Column) -> Column:
    out = F.when(*cases[0])
    for cond, value in cases[1:]:
        out = out.when(cond, value)
    return out.otherwise(default)


def _cost_steps(before: Column, q: Column, p: Column) -> list[Column]:
    """Step on total cost: buys add, sells out of a long scale it down, overselling opens a short at the price."""
    zero, one = F.lit(0.0), F.lit(1.0)
    buy, long_, over = is_buy(), before > 0, q > before
    return [
        _when([(buy, one), (long_ & over, zero), (long_, one - q / before)], one).alias("a"),
        _when([(buy, q * p), (long_ & over, -(q - before) * p), (long_, zero)], -q * p).alias("b"),
        _when([(buy, zero), (long_ & over, F.lit(-1.0)), (long_, -q / before)], zero).alias("c"),
        _when([(buy, zero), (long_ & over, p * before), (long_, p * q)], zero).alias("d"),
    ]


def _average_steps(before: Column, q: Column, p: Column) -> list[Column]:
    """Step on the average cost as the hourly backfill keeps it: a buy that ends flat or short resets to the price."""
    zero, one = F.lit(0.0), F.lit(1.0)
    buy, long_, over, after = is_buy(), before > 0, q > before, before + q
    size = F.abs(before) + q
    return [
        _when([(buy & (after > 0), F.try_divide(before, after)), (buy, zero), (long_ & over, zero), (long_, one)],
              F.try_divide(F.abs(before), size)).alias("a"),
        _when([(buy & (after > 0), F.try_divide(q * p, after)), (buy, p), (long_ & over, p), (long_, zero)],
              F.try_divide(q * p, size)).alias("b"),
        _when([(buy, zero), (long_, -F.least(q, before))], zero).alias("c"),
        _when([(buy, zero), (long_, p * F.least(q, before))], zero).alias("d"),
    ]


def _fold(trades: DataFrame, keys: list[str], step, start: DataFrame | None = None, rows: int = ROWS) -> DataFrame:
    """Final (position, x, y) per key of an affine fold over trades ordered by seq."""
    t = trades.select(*keys, "side", "price", "quantity", "ts", "seq", F.lit(1).cast("long").alias("number")).withColumn(
        "signed", F.when(is_buy(), F.col("quantity")).otherwise(-F.col("quantity")))
    t = running_sums(t, keys, "seq", ["signed", "number"], suffix="_before", before=True)
    if start is None:
        t = t.withColumn("q0", F.lit(0.0))
    else:
        t = t.join(start.select(*keys, F.col("quantity").alias("q0")), keys, "left").withColumn("q0", F.coalesce("q0", F.lit(0.0)))
    steps = t.select(*keys, "number_before", F.col("signed").alias("net"), F.col("ts").alias("updated_at"),
                     *step(F.col("signed_before") + F.col("q0"), F.col("quantity"), F.col("price")))
    return compose_steps(steps, keys, "number_before", sums=["net"], maxima=["updated_at"], rows=rows)


def positions_fold(trades: DataFrame, state: DataFrame | None = None, rows: int = ROWS) -> DataFrame:
    """Average-cost position per (chain, user, symbol), optionally continued from a stored ``state``.

    The position before each trade is a running sum over range partitions; given it, every trade is an affine map of
    (total cost, realised PnL), and at most ``rows`` maps are composed at once. So a trader with a third of all rows, or
    with very many in one instant, is still many small groups.
    """
    keys = ["chain_id", "user_id", "symbol"]
    m = _fold(trades, keys, _cost_steps, state, rows)
    if state is None:
        out = m.select(*keys, F.col("net").alias("quantity"), F.col("b").alias("total_cost"),
                       F.col("d").alias("realized_pnl"), "updated_at")
    else:
        s = state.select(*keys, F.col("quantity").alias("q0"), F.col("total_cost").alias("x0"),
                         F.col("realized_pnl").alias("y0"), F.col("updated_at").alias("u0"))
        z = lambda c, v=0.0: F.coalesce(F.col(c), F.lit(v))
        out = m.join(s, keys, "full_outer").select(
            *keys, (z("q0") + z("net")).alias("quantity"), (z("a", 1.0) * z("x0") + z("b")).alias("total_cost"),
            (z("y0") + z("c") * z("x0") + z("d")).alias("realized_pnl"), F.coalesce("updated_at", "u0").alias("updated_at"))
    flat = F.abs("quantity") < 1e-9
    return out.withColumn("quantity", F.when(flat, 0.0).otherwise(F.col("quantity"))).withColumn(
        "avg_cost", F.when(flat, 0.0).otherwise(F.abs(ratio("total_cost", "quantity")))).select(*POSITION)


def positions_incremental(trades: DataFrame, state: DataFrame, cursors: dict[int, int], rows: int = ROWS) -> DataFrame:
    """State after the trades past each chain's cursor; a chain without one has not been read yet."""
    fresh = trades
    for chain, seq in cursors.items():
        fresh = fresh.filter((F.col("chain_id") != chain) | (F.col("seq") > seq))
    return positions_fold(fresh, state, rows)


def latest_prices(trades: DataFrame, keys: Sequence[str] = ("chain_id", "symbol")) -> DataFrame:
    """Price of the last trade per key, by time where a key spans chains."""
    return trades.groupBy(*keys).agg(F.max_by("price", time_order(trades)).alias("last_price"))


def mark_to_market(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Unrealised PnL of open positions at the latest prices, on what both sides have of chain and symbol."""
    p = positions.drop("unrealized_pnl").join(prices, [c for c in ("chain_id", "symbol") if c in prices.columns], "left")
    open_ = (F.col("quantity") != 0) & F.col("last_price").isNotNull()
    return p.withColumn("unrealized_pnl", F.when(open_, (F.col("last_price") - F.col("avg_cost")) * F.col("quantity")).otherwise(0.0)).drop("last_price")


def positions_query(positions: DataFrame, user: str | None = None, symbol: str | None = None) -> DataFrame:
    p = positions.filter(F.col("quantity") != 0)
    p = p if user is None else p.filter(F.col("user_id") == user)
    return p if symbol is None else p.filter(F.col("symbol") == symbol)


def user_hourly_activity(enriched: DataFrame, start: int, end: int) -> DataFrame:
    """Trades and volume per user and hour from filled or partially filled orders."""
    t = enriched.filter((F.col("ts") >= start) & (F.col("ts") < end) & F.col("status").isin(FILLED_STATUSES))
    return t.groupBy("user_id", bucket("ts", 3600).alias("bucket")).agg(
        F.count(F.lit(1)).alias("trades_count"), F.sum("quote_qty").alias("volume_traded"))


def pnl_hourly_snapshot(positions: DataFrame, enriched: DataFrame, as_of: int) -> DataFrame:
    """PnL per user summed over symbols, with this hour's activity."""
    hour = as_of - as_of % 3600
    live = positions.filter((F.col("quantity") != 0) | (F.col("realized_pnl") != 0) | (F.col("unrealized_pnl") != 0))
    pnl = live.groupBy("user_id").agg(F.sum("realized_pnl").alias("total_realized_pnl"), F.sum("unrealized_pnl").alias("total_unrealized_pnl"))
    act = user_hourly_activity(enriched, hour, hour + 3600).drop("bucket")
    return pnl.join(act, "user_id", "left").select(
        F.lit(hour).cast("long").alias("bucket"), "user_id", (F.col("total_realized_pnl") + F.col("total_unrealized_pnl")).alias("total_pnl"),
        "total_realized_pnl", "total_unrealized_pnl", F.coalesce("trades_count", F.lit(0)).alias("trades_count"),
        F.coalesce("volume_traded", F.lit(0.0)).alias("volume_traded"))


def mark_price_asof(points: DataFrame, trades: DataFrame, depth_prices: DataFrame | None = None, max_age: int = 86400,
                    keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Price per (keys, ts): last trade within a day, else the mean positive depth price, else 0.

    ``depth_prices``: keys, depth_price.
    """
    hits = asof_lookup(points, trades, keys, "ts", ["price"], "seq", max_age).select(*keys, "ts", "price")
    if depth_prices is None:
        return hits.select(*keys, "ts", F.coalesce("price", F.lit(0.0)).alias("mark_price"))
    return hits.join(depth_prices, list(keys), "left").select(
        *keys, "ts", F.coalesce("price", "depth_price", F.lit(0.0)).alias("mark_price"))


def depth_mean_price(depth: DataFrame, pools: DataFrame) -> DataFrame:
    from tickforge.functions.columns import scaled

    d = depth.filter((F.col("quantity") > 0) & (F.col("price") > 0)).join(
        pools.select("chain_id", F.col("order_book").alias("pool_id"), "quote_decimals"), POOL)
    return d.groupBy(F.col("pool_id").alias("symbol")).agg(F.avg(scaled("price", "quote_decimals")).alias("depth_price"))


def pnl_backfill_hourly(trades: DataFrame, start: int, end: int, depth_prices: DataFrame | None = None,
                        stored: DataFrame | None = None, rows: int = ROWS) -> DataFrame:
    """PnL of each user-hour's own trades starting flat, marked at the hour's end; one pass, no loop over hours.

    Positions and marks are kept per chain and symbol. With a ``status`` column only trades of filled and partially
    filled orders count. Rows of ``stored`` (same columns) stay as they are: a user-hour is written once.
    """
    t = trades.filter((F.col("ts") >= start) & (F.col("ts") < end)).withColumn("bucket", bucket("ts", 3600))
    if "status" in trades.columns:
        t = t.filter(F.col("status").isin(FILLED_STATUSES))
    at = ["chain_id", "symbol"]
    folded = _fold(t, [*at, "user_id", "bucket"], _average_steps, rows=rows).select(
        *at, "user_id", "bucket", F.col("net").alias("position"), F.col("b").alias("avg_cost"), F.col("d").alias("realized"))
    ends = t.select(*at, (F.col("bucket") + 3600).alias("ts")).distinct()
    marks = mark_price_asof(ends, trades, depth_prices, keys=at).select(*at, (F.col("ts") - 3600).alias("bucket"), "mark_price")
    open_ = (F.abs("position") > 1e-9) & (F.col("mark_price") > 0)
    pnl = folded.join(marks, [*at, "bucket"], "left").groupBy("bucket", "user_id").agg(
        F.sum("realized").alias("total_realized_pnl"),
        F.sum(F.when(open_, (F.col("mark_price") - F.col("avg_cost")) * F.col("position")).otherwise(0.0)).alias("total_unrealized_pnl"))
    act = t.groupBy("bucket", "user_id").agg(F.count(F.lit(1)).alias("trades_count"), F.sum("quote_qty").alias("volume_traded"))
    fresh = pnl.join(act, ["bucket", "user_id"]).withColumn("total_pnl", F.col("total_realized_pnl") + F.col("total_unrealized_pnl"))
    return fresh if stored is None else insert_ignore(stored, fresh, ["bucket", "user_id"], "bucket")


def hourly_pnl_metrics_agg(positions: DataFrame) -> DataFrame:
    return positions.groupBy(bucket("updated_at", 3600).alias("bucket"), "user_id").agg(
        F.sum("realized_pnl").alias("total_realized_pnl"), F.sum("unrealized_pnl").alias("total_unrealized_pnl"),
        F.sum(F.col("realized_pnl") + F.col("unrealized_pnl")).alias("total_pnl"))


def _total() -> Column:
    return F.round(F.col("realized_pnl") + F.col("unrealized_pnl"), 8)


def pnl_summary(positions: DataFrame) -> DataFrame:
    t = _total()
    return positions.agg(
        F.count(F.lit(1)).alias("total_users"), F.count(F.when(t > 0, 1)).alias("total_gainers"),
        F.count(F.when(t < 0, 1)).alias("total_losers"), F.count(F.when(t == 0, 1)).alias("break_even_traders"),
        F.sum(t).alias("total_pnl"), F.avg(t).alias("avg_pnl"),
        (ratio0(F.count(F.when(t > 0, 1)), F.count(F.lit(1))) * 100).alias("win_rate"))


def pnl_top_performers(positions: DataFrame, kind: str = "all", n: int = 100) -> DataFrame:
    """Best gainers, worst losers or largest absolute PnL."""
    p = positions.withColumn("total_pnl", _total())
    t = F.col("total_pnl")
    if kind == "gainers":
        p, order = p.filter(t > 0), t.desc()
    elif kind == "losers":
        p, order = p.filter(t < 0), t.asc()
    else:
        order = F.abs(t).desc()
    return p.orderBy(order, "user_id", "symbol").limit(n).select(
        "user_id", "symbol", "quantity", "realized_pnl", "unrealized_pnl", "total_pnl", "updated_at")


def pnl_series(hourly: DataFrame, timeframe: str, interval: str, as_of: int) -> DataFrame:
    t = F.col("total_pnl")
    return hourly.filter(in_period("bucket", timeframe, as_of)).groupBy(calendar_bucket("bucket", interval).alias("timestamp")).agg(
        F.sum(t).alias("total_pnl"), F.sum("total_realized_pnl").alias("realized_pnl"), F.sum("total_unrealized_pnl").alias("unrealized_pnl"),
        F.count(F.when(t > 0, 1)).alias("gainers"), F.count(F.when(t < 0, 1)).alias("losers"), F.avg(t).alias("avg_pnl"),
        F.count_distinct("user_id").alias("active_users"))


def portfolio_snapshots(positions: DataFrame, as_of: int, dust: float = 0.001) -> DataFrame:
    """Portfolio value and its positions per user; the array is bounded by the number of symbols."""
    p = positions.filter(F.abs("quantity") > dust)
    return p.groupBy("user_id").agg(
        F.sum(F.abs("quantity") * F.col("avg_cost")).alias("total_value"),
        F.array_sort(F.collect_list(F.struct("symbol", "quantity", "avg_cost"))).alias("positions")).select(
        F.lit(as_of).cast("long").alias("snapshot_ts"), "user_id", "total_value", F.to_json("positions").alias("positions"))
