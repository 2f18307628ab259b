"""Market-data queries over all symbols and users at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.functions.columns import is_buy, mul_div_floor, ratio0
from tickforge.functions.timeutil import in_period
from tickforge.operators.keyed import latest_per_key, top_per_group
from tickforge.plans.orders import OPEN_STATUSES, POOL

SYMBOL = ["chain_id", "symbol"]


def _newest(at: str) -> list:
    """Newest first over all chains, whose sequence numbers cannot be compared with each other."""
    return [F.col(at).desc(), F.col("seq").desc(), F.col("chain_id").asc()]


def resolve_symbol(pools: DataFrame) -> DataFrame:
    """Newest pool per chain and coin."""
    return latest_per_key(pools, ["chain_id", "coin"], ["timestamp", "order_book"])


def recent_trades(trades: DataFrame, limit: int = 100, newest: bool = True) -> DataFrame:
    """Latest (or first) fills per chain and symbol; the maker flag follows the taker side."""
    order = F.col("seq").desc() if newest else F.col("seq").asc()
    return top_per_group(trades, SYMBOL, [order], limit).select(
        *SYMBOL, "trade_id", "price", "quantity", F.col("ts").alias("ts_s"), (F.col("ts") * 1000).alias("time_ms"),
        (~is_buy()).alias("is_buyer_maker"), "rn")


def user_trades(enriched: DataFrame, limit: int = 100) -> DataFrame:
    """Newest fills of every user, attributed through the order id."""
    return top_per_group(enriched, ["user_id"], [*_newest("ts"), F.col("side").asc()], limit).select(
        "chain_id", "user_id", "fill_id", "order_id", "symbol", "side", "price", "quantity", "is_maker", "ts", "rn")


def ticker_24h_from_buckets(daily: DataFrame, trades: DataFrame, spread: DataFrame, as_of: int) -> DataFrame:
    """24h ticker from the newest daily candle in the window, the last trade and the best prices.

    ``spread``: chain_id, symbol, best_bid, best_ask.
    """
    day = latest_per_key(
        daily.filter((F.col("interval") == "1d") & (F.col("open_time") >= as_of - 86400)), SYMBOL, "open_time")
    last = trades.groupBy(*SYMBOL).agg(F.max_by("price", "seq").alias("last_price"),
                                        F.max_by("quantity", "seq").alias("last_qty"),
                                        F.max_by("trade_id", "seq").alias("last_id"))
    j = last.join(day, SYMBOL, "left").join(spread, SYMBOL, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    prev = F.coalesce("open", "last_price")
    return j.select(
        *SYMBOL, (F.col("last_price") - prev).alias("price_change"),
        (ratio0(F.col("last_price") - prev, F.when(prev > 0, prev)) * 100).alias("price_change_percent"),
        zero("average").alias("weighted_avg_price"), prev.alias("prev_close_price"), "last_price", "last_qty",
        zero("best_bid").alias("bid_price"), zero("best_ask").alias("ask_price"), zero("open").alias("open_price"),
        zero("high").alias("high_price"), zero("low").alias("low_price"), zero("volume").alias("volume"),
        zero("quote_volume").alias("quote_volume"),
        (F.coalesce("open_time", F.lit(as_of - 86400).cast("long")) * 1000).alias("open_time_ms"),
        F.lit(as_of * 1000).alias("close_time_ms"), "last_id", F.coalesce("trade_count", F.lit(0)).alias("trade_count"))


def ticker_24h_from_trades(pools: DataFrame, trades: DataFrame, as_of: int) -> DataFrame:
    """24h OHLC and volume from raw trades; symbols without trades report zeros."""
    day = trades.filter(in_period("ts", "24h", as_of)).groupBy(*SYMBOL).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "seq").alias("last"), F.sum("quantity").alias("volume"),
        F.sum("quote_qty").alias("quote_volume"), F.count(F.lit(1)).alias("trade_count"))
    j = pools.select("chain_id", F.col("order_book").alias("symbol")).distinct().join(day, SYMBOL, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    change = F.col("last") - F.col("open")
    percent = F.when(F.col("open") > 0, F.expr("cast(cast((last - open) * 10000 as decimal(38,6)) / cast(open as decimal(20,6)) as bigint)") / 100.0)
    return j.select(*SYMBOL, z("open"), z("high"), z("low"), z("last"), z("volume"), z("quote_volume"),
                    F.coalesce("trade_count", F.lit(0)).alias("trade_count"),
                    F.coalesce(change, F.lit(0.0)).alias("price_change"),
                    F.coalesce(percent, F.lit(0.0)).alias("price_change_percent"))


def ticker_price(pools: DataFrame, trades: DataFrame) -> DataFrame:
    """Last trade price, else the pool's stored price, else zero. ``pools`` may carry ``price``."""
    stored = F.col("price") if "price" in pools.columns else F.lit(None).cast("double")
    last = trades.groupBy(*SYMBOL).agg(F.max_by("price", "seq").alias("last"))
    return pools.select("chain_id", F.col("order_book").alias("symbol"), stored.alias("stored")).join(
        last, SYMBOL, "left").select(*SYMBOL, F.coalesce("last", "stored", F.lit(0.0)).alias("price"))


def _orders_view(orders: DataFrame, pools: DataFrame) -> DataFrame:
    dims = pools.select("chain_id", F.col("order_book").alias("pool_id"), F.col("coin").alias("symbol"), "quote_decimals")
    spent = mul_div_floor("filled", "price", "quote_decimals")
    return orders.join(dims, POOL).select(
        "chain_id", "user_id", "symbol", "order_id", "side", "type", "status", "price", "quantity", "filled",
        spent.alias("cum_quote_qty"), "placed_at", "ts", "seq")


def orders_by_user(orders: DataFrame, pools: DataFrame, limit: int = 500) -> DataFrame:
    """Newest orders of every user with symbol and cumulative quote quantity; chains are ordered by time first."""
    return top_per_group(_orders_view(orders, pools), ["user_id"], _newest("placed_at"), limit)


def open_orders(orders: DataFrame, pools: DataFrame, limit: int = 500) -> DataFrame:
    live = orders.filter(F.col("status").isin(OPEN_STATUSES))
    return top_per_group(_orders_view(live, pools), ["user_id"], _newest("placed_at"), limit)


def trade_init_bundle(orders: DataFrame, pools: DataFrame, enriched: DataFrame, balances: DataFrame) -> dict[str, DataFrame]:
    """The four per-user results a trading screen opens with."""
    return {"orders": orders_by_user(orders, pools), "open_orders": open_orders(orders, pools),
            "trades": user_trades(enriched), "balances": balances}


def pairs(pools: DataFrame) -> DataFrame:
    """Base and quote of every coin; the quote defaults to USDT."""
    parts = F.split("coin", "/")
    return pools.select(
        F.regexp_replace("coin", "/", "").alias("symbol"), parts[0].alias("base"),
        F.coalesce(F.get(parts, F.lit(1)), F.lit("USDT")).alias("quote"), "chain_id", F.col("order_book").alias("pool_id"),
        "base_decimals", "quote_decimals")


def markets(pools: DataFrame, stats: DataFrame, depth: DataFrame, as_of: int) -> DataFrame:
    """Pairs with volume, price, age and book liquidity. ``stats`` comes from pool_running_stats."""
    book = depth.groupBy(*POOL).agg(
        F.sum(F.when(is_buy(), F.col("quantity")).otherwise(F.lit(0))).alias("bid_quantity"),
        F.sum(F.when(~is_buy(), F.col("quantity")).otherwise(F.lit(0))).alias("ask_quantity"),
        F.sum(F.when(is_buy(), F.col("quantity") * F.col("price")).otherwise(F.lit(0))).alias("bid_value"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return pairs(pools).join(pools.select("chain_id", F.col("order_book").alias("pool_id"), "timestamp"), POOL).join(
        stats.select(*POOL, "price", "volume", "volume_in_quote"), POOL, "left").join(
        book, POOL, "left").select(
        "symbol", "base", "quote", *POOL, z("price"), z("volume"), z("volume_in_quote"),
        (F.lit(as_of) - F.col("timestamp")).alias("age_seconds"), z("bid_quantity"), z("ask_quantity"), z("bid_value"))


def user_order_count(orders: DataFrame) -> DataFrame:
    return orders.groupBy("user_id").agg(F.count(F.lit(1)).alias("order_count"))




def adhoc_sql(spark, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """Any statement over the registered state tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)
