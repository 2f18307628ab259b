"""Order-book depth: incremental, rebuilt, snapshot and hourly history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import is_buy, kind_of, scaled
from tickforge.functions.timeutil import bucket
from tickforge.operators.keyed import top_per_group
from tickforge.plans.orders import OPEN_STATUSES, ORDER, POOL

DEFAULT_SPREAD = 0.0125  # fixed value: spread reported for one-sided or crossed books


def depth_rebuild(orders: DataFrame, pool: str | None = None, chain_id: int | None = None) -> DataFrame:
    """Level quantity and order count from open orders."""
    o = orders.filter(F.col("status").isin(OPEN_STATUSES))
    if pool is not None:
        o = o.filter(F.col("pool_id") == pool)
    if chain_id is not None:
        o = o.filter(F.col("chain_id") == chain_id)
    return o.groupBy("chain_id", "pool_id", "side", "price").agg(
        F.sum(F.greatest(F.col("quantity") - F.col("filled"), F.lit(0))).alias("quantity"),
        F.count(F.lit(1)).alias("order_count"), F.max("ts").alias("last_updated"))


def order_deltas(log: DataFrame) -> DataFrame:
    """What each order adds to its own level after all its events.

    Placing adds the quantity and one order; a match removes the executed quantity of both orders; an
    order leaves the count when it is fully filled or ends, and ending removes what is left of it.
    """
    from tickforge.plans.orders import UPDATE_EVENTS, side_name, status_name

    ev = F.col("event_name")
    rows = (
        log.filter(ev.isin("OrderPlaced", "OrderMatched", *UPDATE_EVENTS))
        .withColumn("order_id", F.explode(
            F.when(ev == "OrderMatched", F.array("buy_order_id", "sell_order_id")).otherwise(F.array("order_id"))))
        .withColumn("ends", F.coalesce(ev.isin(UPDATE_EVENTS) & status_name("status_code").isin(
            "CANCELLED", "EXPIRED", "REJECTED"), F.lit(False)))
    )
    placed = ev == "OrderPlaced"
    per_order = rows.groupBy("chain_id", F.col("address").alias("pool_id"), "order_id").agg(
        F.max(F.when(placed, F.col("side_code"))).alias("side_code"),
        F.max(F.when(placed, F.col("price"))).alias("price"),
        F.max(F.when(placed, F.col("quantity"))).alias("placed_qty"),
        F.sum(F.when(ev == "OrderMatched", F.col("quantity")).otherwise(F.lit(0))).alias("matched_qty"),
        F.max("ends").alias("ended"), F.max("block_timestamp").alias("last_updated"),
    ).filter(F.col("placed_qty").isNotNull())
    left = F.col("placed_qty") - F.col("matched_qty")
    gone = F.col("ended") | (left <= 0)
    return per_order.select(
        *ORDER, side_name("side_code").alias("side"), "price",
        F.when(gone, F.lit(0)).otherwise(left).alias("d_qty"),
        F.when(gone, F.lit(0)).otherwise(F.lit(1)).alias("d_count"), "last_updated")


def depth_incremental(log: DataFrame) -> DataFrame:
    """Level state after all events; empty levels are kept with quantity 0 as in an upserted table."""
    return order_deltas(log).groupBy(*POOL, "side", "price").agg(
        F.sum("d_qty").cast(kind_of(log, "quantity")).alias("quantity"), F.sum("d_count").cast("long").alias("order_count"),
        F.max("last_updated").alias("last_updated"))


def best_levels(levels: DataFrame, limit: int, keys: tuple[str, ...] = (*POOL, "side")) -> DataFrame:
    """Best ``limit`` levels per side: bids from the top down, asks from the bottom up."""
    order = F.when(is_buy(), -F.col("price")).otherwise(F.col("price")).asc()
    return top_per_group(levels, keys, [order], limit, "level")


def depth_from_orders(orders: DataFrame, limit: int = 100, pool: str | None = None) -> DataFrame:
    """Aggregate open quantity per price, then keep the best levels of each side."""
    levels = depth_rebuild(orders, pool).filter((F.col("price") > 0) & (F.col("quantity") > 0))
    return best_levels(levels, limit).select(*POOL, "side", "level", "price", "quantity", "order_count")


def depth_from_levels(depth: DataFrame, limit: int = 20) -> DataFrame:
    return best_levels(depth.filter(F.col("quantity") > 0), limit).select(
        *POOL, "side", "level", "price", "quantity", "order_count")


def depth_from_raw_events(log: DataFrame, limit: int = 100) -> DataFrame:
    """Book of everything ever placed as open, summed per price before the limit."""
    from tickforge.plans.orders import fold_orders_placed

    levels = fold_orders_placed(log).filter((F.col("status") == "OPEN") & (F.col("price") > 0)).groupBy(
        *POOL, "side", "price").agg(F.sum("quantity").alias("quantity"), F.count(F.lit(1)).alias("order_count"))
    return best_levels(levels, limit).select(*POOL, "side", "level", "price", "quantity", "order_count")


def current_spread(depth: DataFrame) -> DataFrame:
    live = depth.filter(F.col("quantity") > 0)
    return live.groupBy(*POOL).agg(
        F.max(F.when(is_buy(), F.col("price"))).alias("best_bid"),
        F.min(F.when(~is_buy(), F.col("price"))).alias("best_ask"),
    ).withColumn("spread", F.col("best_ask") - F.col("best_bid"))


def book_snapshot(depth: DataFrame, pools: DataFrame, at: int) -> DataFrame:
    """Current levels valued in quote units, stamped with the snapshot time."""
    dims = pools.select("chain_id", F.col("order_book").alias("pool_id"), F.col("coin").alias("symbol"), "base_decimals",
                        "quote_decimals")
    return (
        depth.filter((F.col("quantity") > 0) & (F.col("price") > 0)).join(dims, POOL)
        .select(F.lit(at).cast("long").alias("snapshot_ts"), *POOL, "symbol", "side", "price", "quantity",
                "order_count", (scaled("quantity", "base_decimals") * scaled("price", "quote_decimals")).alias("liquidity_value"))
    )


def snapshot_aggs() -> list[Column]:
    """Liquidity, order counts and best prices of valued levels."""
    return [
        F.sum(F.when(is_buy(), F.col("liquidity_value")).otherwise(0.0)).alias("bid_liquidity"),
        F.sum(F.when(~is_buy(), F.col("liquidity_value")).otherwise(0.0)).alias("ask_liquidity"),
        F.sum("liquidity_value").alias("total_liquidity"),
        F.sum(F.when(is_buy(), F.col("order_count")).otherwise(F.lit(0))).alias("bid_orders"),
        F.sum(F.when(~is_buy(), F.col("order_count")).otherwise(F.lit(0))).alias("ask_orders"),
        F.max(F.when(is_buy(), F.col("price"))).alias("best_bid"), F.min(F.when(~is_buy(), F.col("price"))).alias("best_ask")]


def book_snapshot_aggregate(snapshots: DataFrame) -> DataFrame:
    """Per pool and snapshot: liquidity, order counts, best prices and relative spread."""
    return with_spread(snapshots.groupBy("snapshot_ts", *POOL, "symbol").agg(*snapshot_aggs()))


def with_spread(out: DataFrame) -> DataFrame:
    sane = (F.col("best_bid") > 0) & (F.col("best_ask") > F.col("best_bid"))
    return out.withColumn("spread", F.when(
        sane, (F.col("best_ask") - F.col("best_bid")) / F.col("best_bid")).otherwise(F.lit(DEFAULT_SPREAD)))


def _level_changes(orders: DataFrame, history: DataFrame, until: int, step: int, since: int | None = None) -> DataFrame:
    """Net (quantity, count) change per level and hour end.

    Only an order's last state inside an hour matters, so history is first reduced to one row per
    (order, hour); the change is that state minus the state of the order's previous hour. All hours before ``since``
    are one, the hour before it.
    """
    hour = bucket("ts", step)
    hour = hour if since is None else F.greatest(hour, F.lit(since - step).cast("long"))
    state = history.filter((F.col("ts") < until)).withColumn("hour", hour).groupBy(
        *ORDER, "hour").agg(
        F.max_by(F.col("status").isin(OPEN_STATUSES), "seq").alias("live"), F.max("filled").alias("filled"))
    ledger = state.join(orders.select(*ORDER, "side", "price", "quantity").filter("price > 0"), ORDER)
    w = Window.partitionBy(*ORDER).orderBy("hour")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    rem = ledger.withColumn("filled", F.max("filled").over(run)).withColumn(
        "rem", F.when(F.col("live"), F.greatest(F.col("quantity") - F.col("filled"), F.lit(0))).otherwise(F.lit(0))
    ).withColumn("cnt", (F.col("rem") > 0).cast("long"))
    return rem.withColumn("dq", F.col("rem") - F.lag("rem", 1, 0).over(w)).withColumn(
        "dc", F.col("cnt") - F.lag("cnt", 1, 0).over(w)
    ).groupBy(*POOL, "side", "price", "hour").agg(F.sum("dq").alias("dq"), F.sum("dc").alias("dc"))


def book_history_hourly(orders: DataFrame, history: DataFrame, start: int | None, until: int, step: int = 3600,
                        seed: DataFrame | None = None) -> DataFrame:
    """Level quantities at the end of every hour in ``[start, until)``, or since the first change without ``start``.

    Only non-empty validity intervals (``book_spans``) are expanded into hours. The work is the size of the answer;
    no order is expanded.
    """
    return book_spans(orders, history, start, until, step, seed).select(
        F.explode(F.sequence("from", "to", F.lit(step).cast("long"))).alias("hour"), *POOL, "side", "price",
        "quantity", "order_count")


def book_spans(orders: DataFrame, history: DataFrame, start: int | None, until: int, step: int = 3600,
               seed: DataFrame | None = None) -> DataFrame:
    """Spans of hours, first (``from``) to last (``to``), in which a level is not empty and does not change.

    Per level: running sum of the hourly changes gives the state, the next change bounds its validity.
    Without ``start`` a level's first hour is that of its first change. ``seed`` (chain_id, pool_id, side, price, quantity, order_count) is the book before
    ``start``; of earlier history only the last state of every order is kept then.
    """
    changes = _level_changes(orders, history, until, step, None if seed is None else start)
    if seed is not None:
        changes = changes.filter(F.col("hour") >= start).unionByName(seed.select(
            *POOL, "side", "price", F.lit(start - step).cast("long").alias("hour"),
            F.col("quantity").alias("dq"), F.col("order_count").cast("long").alias("dc")))
    w = Window.partitionBy(*POOL, "side", "price").orderBy("hour")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    valid = (
        changes.withColumn("quantity", F.sum("dq").over(run)).withColumn("order_count", F.sum("dc").over(run))
        .withColumn("to", F.coalesce(F.lead("hour").over(w), F.lit(until).cast("long")) - step)
        .withColumn("from", F.col("hour") if start is None else F.greatest(F.col("hour"), F.lit(start).cast("long")))
        .filter((F.col("quantity") > 0) & (F.col("order_count") > 0) & (F.col("to") >= F.col("from")))
    )
    return valid.select(*POOL, "side", "price", "quantity", "order_count", "from", "to")


def book_spans_all(orders: DataFrame, history: DataFrame, until: int, step: int = 3600) -> DataFrame:
    """``book_spans`` from the hour of the first event on; empty without events."""
    return book_spans(orders, history, None, until, step)


def book_history_all(orders: DataFrame, history: DataFrame, until: int, step: int = 3600) -> DataFrame:
    """``book_history_hourly`` from the hour of the first event on; empty without events."""
    return book_history_hourly(orders, history, None, until, step)


def first_hour(history: DataFrame, step: int = 3600) -> int | None:
    first = history.agg(F.min("ts")).head()[0]
    return None if first is None else first - first % step


def book_history_resume(orders: DataFrame, history: DataFrame, stored: DataFrame, until: int,
                        fresh: int = 300, step: int = 3600) -> DataFrame:
    """Continue from the last stored hour; nothing to do when it is younger than ``fresh`` seconds.

    ``stored`` has the hours themselves (``book_history_hourly``) or the spans that hold them (``book_spans``).
    """
    at = "to" if "to" in stored.columns else "hour"
    last = stored.agg(F.max(at)).head()[0]
    if last is None:
        return book_history_all(orders, history, until, step)
    if until - last < fresh:
        return stored.limit(0).select(F.col(at).alias("hour"), *POOL, "side", "price", "quantity", "order_count")
    start = last + step
    return book_history_hourly(orders, history, start, until, step, stored.filter(F.col(at) == last))
