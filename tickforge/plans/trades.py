"""Enriched trades and candles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.functions.columns import is_buy, scaled
from tickforge.functions.timeutil import KLINE_INTERVALS, bucket
from tickforge.plans.orders import ORDER, POOL


def trades_enriched(order_trades: DataFrame, orders: DataFrame, pools: DataFrame) -> DataFrame:
    """Fill sides with their order's user and human amounts; joined on order id, so no fan-out."""
    owner = orders.select(*ORDER, "user_id", "status")
    dims = pools.select("chain_id", F.col("order_book").alias("pool_id"), F.col("coin").alias("symbol"), "base_decimals",
                        "quote_decimals")
    price, qty = scaled("price", "quote_decimals"), scaled("quantity", "base_decimals")
    return order_trades.join(owner, ORDER).join(dims, POOL).select(
        "chain_id", "fill_id", "user_id", "symbol", "pool_id", "side", "order_id", "is_maker", price.alias("price"),
        qty.alias("quantity"), (price * qty).alias("quote_qty"), "ts", "seq", "status")


def human_fills(fill_rows: DataFrame, pools: DataFrame) -> DataFrame:
    """Fills in human units, one row per match."""
    dims = pools.select("chain_id", F.col("order_book").alias("pool_id"), F.col("coin").alias("symbol"), "base_decimals",
                        "quote_decimals")
    price, qty = scaled("price", "quote_decimals"), scaled("quantity", "base_decimals")
    return fill_rows.join(dims, POOL).select(
        "chain_id", F.col("fill_id").alias("trade_id"), F.col("taker").alias("user_id"), "symbol", "pool_id", "side",
        (F.col("side") == "Buy").alias("is_buyer"), price.alias("price"), qty.alias("quantity"),
        (price * qty).alias("quote_qty"), "ts", "seq")


def klines(trades: DataFrame, intervals: dict[str, int] | None = None) -> DataFrame:
    """Candles for every interval. Raw trades are reduced to minutes once; minutes feed the rest."""
    intervals = intervals or KLINE_INTERVALS
    base = 60 if all(s % 60 == 0 for s in intervals.values()) else 1
    fine = trades.groupBy("chain_id", "symbol", bucket("ts", base).alias("b")).agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"), F.sum("price").alias("psum"), F.sum("quantity").alias("volume"),
        F.sum("quote_qty").alias("quote_volume"), F.count(F.lit(1)).alias("trade_count"),
        F.sum(F.when(is_buy(), F.col("quantity")).otherwise(0.0)).alias("tb"),
        F.sum(F.when(is_buy(), F.col("quote_qty")).otherwise(0.0)).alias("tq"),
    )
    steps = F.explode(F.array(*[
        F.struct(F.lit(n).alias("interval"), F.lit(s).cast("long").alias("step")) for n, s in intervals.items()]))
    wide = fine.withColumn("i", steps).select("*", "i.interval", "i.step").withColumn(
        "open_time", bucket("b", F.col("step")))
    return wide.groupBy("chain_id", "symbol", "interval", "open_time", "step").agg(
        F.min_by("open", "b").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "b").alias("close"), (F.sum("psum") / F.sum("trade_count")).alias("average"),
        F.sum("volume").alias("volume"), F.sum("quote_volume").alias("quote_volume"),
        F.sum("trade_count").alias("trade_count"), F.sum("tb").alias("taker_buy_base_volume"),
        F.sum("tq").alias("taker_buy_quote_volume"),
    ).select(
        "chain_id", "symbol", "interval", "open_time", (F.col("open_time") + F.col("step") - 1).alias("close_time"), "open",
        "high", "low", "close", "average", "volume", "quote_volume", "trade_count", "taker_buy_base_volume",
        "taker_buy_quote_volume")


def kline_query(candles: DataFrame, interval: str, start: int, end: int, limit: int, last: bool = False,
                symbol: str | None = None) -> DataFrame:
    """First (or last) ``limit`` candles per chain and symbol with open time in ``[start, end]``."""
    from tickforge.operators.keyed import top_per_group

    c = candles.filter((F.col("interval") == interval) & F.col("open_time").between(start, end))
    if symbol is not None:
        c = c.filter(F.col("symbol") == symbol)
    order = F.col("open_time").desc() if last else F.col("open_time").asc()
    return top_per_group(c, ["chain_id", "symbol"], [order], limit).drop("rn")


def kline_tuple(candles: DataFrame) -> DataFrame:
    """Exchange-style candle: millisecond times, prices and volumes as text, a trailing "0"."""
    text = lambda c, d=2: F.format_string(f"%.{d}f", F.col(c))
    return candles.select(
        "chain_id", "symbol", "interval", (F.col("open_time") * 1000).alias("open_time_ms"), text("open").alias("open"),
        text("high").alias("high"), text("low").alias("low"), text("close").alias("close"),
        text("volume").alias("volume"), (F.col("close_time") * 1000).alias("close_time_ms"),
        text("quote_volume").alias("quote_volume"), "trade_count", text("taker_buy_base_volume").alias("taker_buy_base_volume"),
        text("taker_buy_quote_volume").alias("taker_buy_quote_volume"), F.lit("0").alias("ignored"))
