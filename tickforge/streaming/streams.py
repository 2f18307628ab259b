"""The folds and projections of the batch plans on unbounded inputs.

Every function takes and returns a DataFrame that may be streaming; ``run`` drains one into a Parquet
folder with a checkpoint. Watermarks default to ten minutes; later rows are dropped here. ``late`` has candles and
deduplication that keep and repair them, ``stateful`` the streams with state of their own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tickforge.functions.columns import is_buy
from tickforge.session import scratch_path

WATERMARK = "10 minutes"
MAKER_FEE, TAKER_FEE = 0.001, 0.002  # fixed values
TOPIC_KEEP, TOPIC_KEEP_DEPTH = 1000, 500  # fixed values: entries kept per topic

# Fields and types of every topic's record.
TOPICS = {
    "trades": "symbol string, price double, quantity double, timestamp bigint, userId string, side string, tradeId string, orderId string, makerOrderId string",
    "balances": "userId string, token string, available double, locked double, timestamp bigint",
    "orders": "orderId string, userId string, symbol string, side string, type string, price double, quantity double, filledQuantity double, status string, timestamp bigint",
    "depth": "symbol string, bids string, asks string, timestamp bigint",
    "klines": "symbol string, interval string, openTime bigint, closeTime bigint, open double, high double, low double, close double, volume double, trades bigint",
    "execution_reports": "orderId string, userId string, symbol string, side string, type string, price double, quantity double, filledQuantity double, status string, timestamp bigint, executionType string",
    "chain_balances": "eventType string, userId string, token string, amount double, chainId int, timestamp bigint, transactionId string, blockNumber bigint",
    "lending": "action string, user string, token string, amount double, timestamp bigint, collateralToken string, debtToken string, healthFactor double, liquidator string",
    "liquidations": "liquidatedUser string, liquidator string, collateralToken string, debtToken string, collateralAmount double, debtAmount double, healthFactor double, price double, timestamp bigint",
    "yield_accruals": "user string, token string, yieldType string, amount double, interestRate double, timestamp bigint, cumulativeYield double",
    "price_updates": "token string, price double, decimals int, source string, timestamp bigint, confidence double",
}


def stream_source(spark: SparkSession, path: str, schema, max_files: int | None = None, pattern: str | None = None) -> DataFrame:
    """Parquet folder as a stream; the checkpoint of the running query is the consumer offset."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.parquet(path)


def topic_key(chain_id: int | Column, kind: str | Column) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(str(v))
    return F.concat(F.lit("chain:"), lit(chain_id).cast("string"), F.lit(":"), lit(kind))


def stream_parse_route(raw: DataFrame, kind: str, *more: str) -> DataFrame:
    """Typed records of one topic from (topic, fields map), with ``more`` columns; the route is the last key segment."""
    cols = [c.strip().split(" ") for c in TOPICS[kind].split(",")]
    mine = raw.filter(F.element_at(F.split("topic", ":"), -1) == kind)
    typed = [F.expr(f"try_cast(fields['{n}'] as {t})").alias(n) for n, t in cols]
    return mine.select("topic", *more, *typed)


def invalid_reason(kind: str, required: tuple[str, ...]) -> Column:
    """Why a raw message cannot be used, or null: a required field missing or not of its type."""
    types = dict(c.strip().split(" ") for c in TOPICS[kind].split(","))
    why = F.lit(None).cast("string")
    for n in reversed(required):
        bad = F.expr(f"try_cast(fields['{n}'] as {types[n]}) is null")
        why = F.when(bad, F.lit(f"missing or malformed {n}")).otherwise(why)
    return why


def with_event_time(rows: DataFrame, ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    return rows.withColumn("event_time", F.timestamp_seconds(ts)).withWatermark("event_time", watermark)


def stream_dedup(rows: DataFrame, keys: list[str], ts: str = "ts", watermark: str = WATERMARK) -> DataFrame:
    """Drop redelivered rows whose key was seen inside the watermark."""
    return with_event_time(rows, ts, watermark).dropDuplicatesWithinWatermark(keys)


def stream_klines(trades: DataFrame, interval: str, watermark: str = WATERMARK) -> DataFrame:
    """Tumbling candles; open and close follow the event order, not the arrival order."""
    timed = trades if "event_time" in trades.columns else with_event_time(trades, "ts", watermark)
    agg = timed.groupBy(F.window("event_time", interval), "chain_id", "symbol").agg(
        F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", "seq").alias("close"), F.sum("quantity").alias("volume"), F.sum("quote_qty").alias("quote_volume"),
        F.count(F.lit(1)).alias("trade_count"),
        F.sum(F.when(is_buy(), F.col("quantity")).otherwise(0.0)).alias("taker_buy_base_volume"))
    return agg.select("chain_id", "symbol", F.unix_timestamp("window.start").alias("open_time"),
                      (F.unix_timestamp("window.end") - 1).alias("close_time"), "open", "high", "low", "close", "volume",
                      "quote_volume", "trade_count", "taker_buy_base_volume")


def stream_trades(trades: DataFrame) -> DataFrame:
    """Public trade tick."""
    return trades.select(
        F.lit("trade").alias("event"), (F.col("ts") * 1000).alias("event_ms"), F.upper("symbol").alias("symbol"), "trade_id",
        "price", "quantity", (~is_buy()).alias("buyer_is_maker"))


def quote_asset(symbol: str = "symbol") -> Column:
    return F.coalesce(F.get(F.split(symbol, "/"), F.lit(1)), F.lit("USDT"))


def stream_user_trades(trades: DataFrame) -> DataFrame:
    """Private trade tick with the taker commission in the quote asset."""
    return trades.select(
        F.lit("userTrade").alias("event"), (F.col("ts") * 1000).alias("event_ms"), "user_id", F.upper("symbol").alias("symbol"),
        "trade_id", "price", "quantity", F.upper("side").alias("side"),
        (F.col("price") * F.col("quantity") * TAKER_FEE).alias("commission"), quote_asset().alias("commission_asset"),
        is_buy().alias("is_buyer"))


def stream_execution_reports(orders: DataFrame) -> DataFrame:
    """Order events as execution reports with quote quantity, commission and working flag.

    Needs user_id, order_id, symbol, side, type, status, price, quantity, filled, is_maker, ts.
    """
    quote = F.col("filled") * F.col("price")
    return orders.select(
        F.lit("executionReport").alias("event"), (F.col("ts") * 1000).alias("event_ms"), "user_id", "order_id",
        F.upper("symbol").alias("symbol"), F.upper("side").alias("side"), F.upper("type").alias("type"),
        F.upper("status").alias("status"), "price", "quantity", F.col("filled").alias("cumulative_filled"),
        quote.alias("cumulative_quote"), (quote * F.when(F.col("is_maker"), MAKER_FEE).otherwise(TAKER_FEE)).alias("commission"),
        quote_asset().alias("commission_asset"), F.upper("status").isin("NEW", "OPEN", "PARTIALLY_FILLED").alias("is_working"))


def stream_price_updates(prices: DataFrame) -> DataFrame:
    return prices.select("token", "price", F.coalesce("decimals", F.lit(18)).alias("decimals"),
                         F.coalesce("source", F.lit("CHAINLINK")).alias("source"), "ts")


def stream_lending_events(lending: DataFrame) -> DataFrame:
    return lending.select(F.lower("action").alias("action"), F.col("user_id").alias("user"), "token", "amount",
                          F.when(F.col("action") == "LIQUIDATE", F.col("liquidator")).alias("liquidator"), "ts")


def stream_liquidations(lending: DataFrame) -> DataFrame:
    return lending.filter(F.col("action") == "LIQUIDATE").select(
        F.col("user_id").alias("liquidated_user"), "liquidator", F.col("token").alias("collateral_token"), "debt_token",
        F.col("amount").alias("debt_amount"), "ts")


def stream_yield(accruals: DataFrame) -> DataFrame:
    """Yield accrual records with their type in lower case."""
    return accruals.select(F.col("user_id").alias("user"), "token", F.lower("yield_type").alias("yield_type"), "amount", "ts")


# --- sinks ---------------------------------------------------------------------------------------
def run(df: DataFrame, label: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None,
        path: str | None = None, name: str | None = None) -> tuple[str, StreamingQuery]:
    """Drain a stream once (availableNow) and return the output folder and the finished query.

    Append mode writes files directly. Update and complete mode write every batch with its number, and
    readers keep the newest row per ``keys`` (see ``read_latest``).
    """
    spark = df.sparkSession
    out = path or scratch_path(spark, label)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}-offsets").trigger(availableNow=True)
    if name is not None:
        writer = writer.queryName(name)
    if each is not None:
        q = writer.foreachBatch(each).start()
    elif mode == "append":
        q = writer.format("parquet").option("path", out).start()
    else:
        def keep(batch: DataFrame, n: int) -> None:
            batch.withColumn("_batch", F.lit(n).cast("long")).write.mode("overwrite").option(
                "partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(out)
        q = writer.foreachBatch(keep).start()
    q.awaitTermination()
    return out, q


def read_latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Newest version of every key written by an update-mode ``run``."""
    from tickforge.operators.keyed import latest_per_key

    rows = spark.read.parquet(path)
    return latest_per_key(rows, keys, "_batch").drop("_batch")


def topic_fanout(topic: Column, path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer: each record as JSON in its topic's folder. A replayed batch overwrites itself."""
    def write(batch: DataFrame, n: int) -> None:
        payload = F.to_json(F.struct(*[c for c in batch.columns]))
        batch.select(topic.alias("topic"), F.lit(n).cast("long").alias("batch"), F.col("seq"), payload.alias("payload")).write.mode(
            "overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("topic", "batch").parquet(path)
    return write


def topic_trim(entries: DataFrame, keep: int = TOPIC_KEEP, keep_depth: int = TOPIC_KEEP_DEPTH) -> DataFrame:
    """Newest entries per topic: the retention job, for those who want topics capped; nothing else trims them."""
    from tickforge.operators.keyed import top_per_group

    depth = F.element_at(F.split("topic", ":"), -1) == "depth"
    kept = top_per_group(entries, ["topic"], [F.col("seq").desc()], max(keep, keep_depth))
    return kept.filter(F.col("rn") <= F.when(depth, keep_depth).otherwise(keep)).drop("rn")
