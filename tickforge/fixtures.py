"""Exchange-shaped views over the star-schema test tables (see FIXTURES.md).

Every view is a projection of a whole table: each ``events`` row becomes one trade, three orders, one
match and their follow-up events; each ``part`` row becomes one currency and its registry events.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.functions.columns import seq
from tickforge.plans import books, orders, trades
from tickforge.session import pin_utc

AS_OF = 1706659200  # 2024-01-31 00:00:00 UTC
CHAIN = 1
LOG_SCHEMA = """event_name string, log_index bigint, block_timestamp bigint, order_id bigint, user_id string,
 side_code int, price bigint, quantity bigint, is_market boolean, status_code int, filled bigint,
 buy_order_id bigint, sell_order_id bigint"""


class Fixtures:
    """Lazily built views for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = pin_utc(spark)
        self.sf_dir = str(sf_dir).rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def base(self) -> DataFrame:
        """One row per event with the integers every other view is built from.

        The test file is a single row group, which is one task; batch reads spread it. Spark sets the number of partitions by
        their size, so that a larger table makes more tasks and not larger ones.
        """
        raw = self.table("events")
        if not raw.isStreaming:
            raw = raw.repartition("event_id")
        return raw.select(
            F.col("event_id").alias("e"), F.col("user_id").alias("u"), F.col("event_type").alias("pool"),
            F.col("value"), F.round(F.col("value") * 100).cast("bigint").alias("p"),
            (F.regexp_extract("props", "[0-9]+", 0).cast("bigint") + 1).alias("q"),
            F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"),
        ).withColumn("chain", F.when(F.col("e") % 7 == 3, 2).otherwise(CHAIN)).withColumn(
            "o", F.when(F.col("e") % 7 == 3, F.col("e") - 1).otherwise(F.col("e")))  # the second chain repeats order ids

    @cached_property
    def trades(self) -> DataFrame:
        buy = F.col("e") % 2 == 0
        return self.base.select(
            F.col("chain").alias("chain_id"), F.col("e").alias("trade_id"), F.col("u").cast("string").alias("user_id"),
            F.col("pool").alias("symbol"), F.col("pool").alias("pool_id"),
            F.when(buy, "Buy").otherwise("Sell").alias("side"), buy.alias("is_buyer"),
            F.col("value").alias("price"), F.col("q").cast("double").alias("quantity"),
            (F.col("value") * F.col("q").cast("double")).alias("quote_qty"), F.col("t").alias("ts"),
            F.when(F.col("chain") == 2, F.col("e") - 1_000_000_000).otherwise(F.col("e")).alias("seq"),  # each chain counts its own blocks
        )

    @cached_property
    def event_log(self) -> DataFrame:
        """Placed, matched, cancelled and update events of the order book, in block order."""
        typed = f"struct<{','.join(f.strip().replace(' ', ':') for f in LOG_SCHEMA.split(','))}>"
        n = lambda t: f"cast(null as {t})"
        side = "cast(e % 2 as int)"
        passive = "cast((e div 2) % 2 as int)"
        passive_price = "if((e div 2) % 2 = 0, greatest(1L, p * 9 div 10), p * 11 div 10 + 1)"
        maker = "cast(u + 1 + e % 7 as string)"
        taker = "cast(u as string)"

        def row(name, log, time, order, user=n("string"), side_=n("int"), price=n("bigint"), qty=n("bigint"),
                market="false", status=n("int"), filled=n("bigint"), buy=n("bigint"), sell=n("bigint")):
            return (f"cast(struct('{name}', e * 8 + {log}, {time}, {order}, {user}, {side_}, {price}, {qty}, "
                    f"{market}, {status}, {filled}, {buy}, {sell}) as {typed})")

        rows = [
            row("OrderPlaced", 0, "t", "o * 3", taker, side, "p", "q", "e % 5 = 0", "0"),
            row("OrderPlaced", 1, "t - 60", "o * 3 + 1", maker, f"1 - {side}", "p", "q + e % 3", "false", "0"),
            row("OrderPlaced", 2, "t + 1", "o * 3 + 2", taker, passive, passive_price, "q", "false", "0"),
            row("OrderMatched", 3, "t", n("bigint"), taker, side, "p", "q", "false", n("int"), n("bigint"),
                "if(e % 2 = 0, o * 3, o * 3 + 1)", "if(e % 2 = 0, o * 3 + 1, o * 3)"),
            f"if(e % 3 = 2, {row('OrderCancelled', 4, 't + 1 + (e % 72) * 3600', 'o * 3 + 1', maker, status='3')}, null)",
            f"if(e % 4 = 1, {row('UpdateOrder', 5, 't + 2 + (e % 72) * 3600', 'o * 3 + 2', status='5', filled='0L')}, "
            f"if(e % 4 = 2, {row('OrderCancelled', 5, 't + 2 + (e % 72) * 3600', 'o * 3 + 2', taker, status='3')}, null))",
            row("UpdateOrder", 6, "t", "o * 3", status="2", filled="q"),
            row("UpdateOrder", 7, "t", "o * 3 + 1", status="if(e % 3 = 0, 2, 1)", filled="q"),
        ]
        return (
            self.base.select("chain", "pool", F.explode(F.expr(f"array({', '.join(rows)})")).alias("x")).filter("x IS NOT NULL")
            .select(F.col("chain").alias("chain_id"), F.col("pool").alias("address"), "x.*")
            .withColumn("block_number", F.col("block_timestamp"))
            .withColumn("tx_hash", F.sha2(F.col("log_index").cast("string"), 256))
            .withColumn("seq", seq())
        )

    @cached_property
    def pools(self) -> DataFrame:
        """Pool dimension: price has two decimals, quantity none."""
        return self.trades.groupBy("chain_id", "symbol").agg(F.min("ts").alias("timestamp")).select(
            F.sha2(F.concat(F.col("chain_id").cast("string"), F.lit("_"), "symbol"), 256).alias("id"), "chain_id",
            F.concat("symbol", F.lit("/usd")).alias("coin"), F.col("symbol").alias("order_book"),
            F.lit(0).alias("base_decimals"), F.lit(2).alias("quote_decimals"), "timestamp",
        )

    @cached_property
    def orders(self) -> DataFrame:
        return orders.order_current_state(self.event_log)

    @cached_property
    def order_history(self) -> DataFrame:
        return orders.order_history_log(self.event_log)

    @cached_property
    def fills(self) -> DataFrame:
        return orders.fills(self.event_log)

    @cached_property
    def order_trades(self) -> DataFrame:
        """One row per order side of a fill."""
        return orders.explode_fills(self.event_log)

    @cached_property
    def trades_enriched(self) -> DataFrame:
        return trades.trades_enriched(self.order_trades, self.orders, self.pools)

    @cached_property
    def depth(self) -> DataFrame:
        return books.depth_rebuild(self.orders)

    @cached_property
    def book_snapshots(self) -> DataFrame:
        return self.trades.filter(F.col("side") == "Sell").select(
            "symbol", "ts", "seq", (F.col("price") * 0.999).alias("best_bid"),
            (F.col("price") * 1.001).alias("best_ask"))

    @cached_property
    def ledger_events(self) -> DataFrame:
        op = (F.when(F.col("pool") == "signup", "deposit").when(F.col("pool") == "view", "lock")
              .when(F.col("pool") == "click", "unlock").when(F.col("pool") == "purchase", "withdraw")
              .when(F.col("e") % 2 == 0, "transfer").otherwise("transfer_locked"))
        return self.base.select(
            op.alias("op"), F.lit(CHAIN).alias("chain_id"), F.col("u").cast("string").alias("user_id"),
            F.concat(F.lit("c"), (F.col("e") % 5).cast("string")).alias("currency"), F.col("p").alias("amount"),
            F.floor(F.col("p") / 100).alias("fee"), ((F.col("u") + 1 + F.col("e") % 7).cast("string")).alias("receiver"),
            F.lit("operator").alias("operator"), F.col("t").alias("ts"), F.col("t").alias("block_number"),
            F.col("e").alias("log_index"), F.sha2(F.col("e").cast("string"), 256).alias("tx_hash"), F.col("e").alias("seq"),
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.trades.groupBy("user_id").agg(
            F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))

    @cached_property
    def lending_raw(self) -> DataFrame:
        action = (F.when(F.col("pool") == "signup", "SUPPLY").when(F.col("pool") == "view", "BORROW")
                  .when(F.col("pool") == "click", "REPAY").when(F.col("pool") == "purchase", "WITHDRAW")
                  .otherwise("LIQUIDATE"))
        return self.base.select(
            action.alias("action"), F.lit(CHAIN).alias("chain_id"), F.col("u").cast("string").alias("user_id"),
            F.concat(F.lit("t"), (F.col("e") % 40).cast("string")).alias("token"),
            F.concat(F.lit("t"), ((F.col("e") + 1) % 40).cast("string")).alias("debt_token"),
            F.col("p").alias("amount"), F.floor(F.col("p") / 20).alias("interest"),
            (F.col("u") + 3).cast("string").alias("liquidator"), F.col("t").alias("ts"),
            F.sha2(F.col("e").cast("string"), 256).alias("tx_hash"), F.col("e").alias("seq"),
        )

    @cached_property
    def oracle_events(self) -> DataFrame:
        return self.base.select(
            F.lit(CHAIN).alias("chain_id"), F.concat(F.lit("t"), (F.col("e") % 40).cast("string")).alias("token"),
            F.col("p").alias("price"), F.when(F.col("e") % 3 == 0, "TWAP").alias("source"),
            F.when(F.col("e") % 4 == 0, F.lit(6)).alias("decimals"), F.col("t").alias("ts"), F.col("e").alias("seq"),
        )

    @cached_property
    def asset_config_events(self) -> DataFrame:
        unit = F.lit(10**14).cast("decimal(38,0)")
        raw = lambda c: (c.cast("decimal(18,0)") * unit).cast("decimal(38,0)")
        return self.base.select(
            F.lit(CHAIN).alias("chain_id"), F.concat(F.lit("t"), (F.col("e") % 40).cast("string")).alias("token"),
            raw(6000 + (F.col("q") * 41) % 3000).alias("collateral_factor"),
            raw(7000 + (F.col("q") * 37) % 2000).alias("liquidation_threshold"),
            raw(F.lit(500) + F.col("q")).alias("liquidation_bonus"),
            raw((F.col("q") % 20) * 100).alias("reserve_factor"), F.col("t").alias("ts"), F.col("e").alias("seq"),
        )

    @cached_property
    def bridge_messages(self) -> DataFrame:
        m = F.col("e") % 3
        return self.base.select(
            F.when(m == 1, F.col("e") - 1).otherwise(F.col("e")).alias("message_id"),
            F.when(m == 1, "PROCESS").otherwise("DISPATCH").alias("type"),
            F.when(m == 1, F.lit(2)).otherwise(F.lit(CHAIN)).alias("chain_id"),
            F.concat(F.lit("tx"), F.col("e").cast("string")).alias("tx_hash"), F.col("u").cast("string").alias("user_id"),
            F.col("t").alias("ts"), F.col("e").alias("seq"),
        )

    @cached_property
    def bridge_deposits(self) -> DataFrame:
        return self.base.select(
            F.col("e").alias("deposit_id"), F.lit(CHAIN).alias("chain_id"), F.col("u").cast("string").alias("user_id"),
            F.concat(F.lit("c"), (F.col("e") % 5).cast("string")).alias("token"), F.col("p").alias("amount"),
            F.concat(F.lit("tx"), F.col("e").cast("string")).alias("tx_hash"), F.col("t").alias("ts"), F.col("e").alias("seq"),
        )

    @cached_property
    def chain_balance_events(self) -> DataFrame:
        op = (F.when(F.col("pool") == "signup", "deposit").when(F.col("pool") == "purchase", "withdraw")
              .when(F.col("pool") == "click", "unlock").when(F.col("pool") == "view", "claim")
              .otherwise("whitelist"))
        return self.base.select(
            op.alias("op"), F.lit(CHAIN).alias("chain_id"), F.col("u").cast("string").alias("user_id"),
            F.concat(F.lit("c"), (F.col("e") % 5).cast("string")).alias("token"), F.col("p").alias("amount"),
            (F.col("q") % 2 == 0).alias("is_whitelisted"), F.sha2(F.col("e").cast("string"), 256).alias("tx_hash"),
            F.col("e").alias("log_index"), F.col("t").alias("ts"), F.col("e").alias("seq"),
        )

    @cached_property
    def registry_events(self) -> DataFrame:
        """Token-mapping events, one per ``part`` row; four rows share a source token."""
        k = F.col("p_partkey")
        op = (F.when(k % 4 == 0, "register").when(k % 4 == 1, "update").when(k % 4 == 2, "toggle")
              .otherwise(F.when(k % 3 == 0, "deactivate").otherwise("update")))
        token = F.floor(k / 4)
        return self.table("part").select(
            op.alias("op"), (token % 3 + 1).cast("int").alias("source_chain"),
            F.concat(F.lit("0x"), token.cast("string")).alias("source_token"),
            (token % 2 + 100).cast("int").alias("target_chain"),
            F.when(op.isin("register", "update"), F.concat(F.lit("0xs"), k.cast("string"))).alias("synthetic_token"),
            F.when(op == "register", F.concat(F.lit("SYM"), token.cast("string"))).alias("symbol"),
            F.when(op == "register", (F.col("p_size") % 18 + 1).cast("int")).alias("source_decimals"),
            F.when(op == "toggle", F.col("p_size") % 2 == 0).when(op == "deactivate", F.lit(False))
            .when(op == "register", F.lit(True)).alias("is_active"), k.alias("seq"),
        )

    @cached_property
    def currencies(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").select(
            F.concat(F.lit("c"), k.cast("string")).alias("address"), F.lit(CHAIN).alias("chain_id"),
            F.concat(F.lit("gs"), F.upper(F.substring("p_type", 1, 3)), k.cast("string")).alias("symbol"),
            F.col("p_name").alias("name"), (F.col("p_size") % 3).cast("int").alias("decimals"),
            F.when(F.col("p_size") % 2 == 0, "underlying").otherwise("synthetic").alias("token_type"),
            (F.col("p_size") % 5 != 0).alias("is_active"), k.alias("seq"),
        )

    @cached_property
    def faucet_events(self) -> DataFrame:
        step = F.col("e") % 3
        return self.base.select(
            F.floor(F.col("e") / 3).alias("request_id"), F.concat(F.lit("0xAb"), F.floor(F.col("e") / 3) % 50).alias("address"),
            (F.floor(F.col("e") / 3) % 2 + 1).cast("int").alias("chain_id"),
            F.when(step == 0, "pending").when(step == 1, F.lit(None)).otherwise(
                F.when(F.col("q") % 4 == 0, "failed").otherwise("completed")).alias("status"),
            F.when(step == 1, F.concat(F.lit("tx"), F.col("e").cast("string"))).alias("tx_hash"),
            F.when((step == 2) & (F.col("q") % 4 == 0), "rejected").alias("error"),
            F.col("t").alias("ts"), F.col("e").alias("seq"),
        )

    @cached_property
    def sync_log(self) -> DataFrame:
        done = ~((F.col("t") < 1704153600) | F.col("t").between(1704844800, 1704931200) | (F.col("t") >= 1706572800))
        return self.base.select(
            F.col("chain").alias("chain_id"), F.col("e").alias("trade_id"), F.lit("analytics").alias("service"),
            F.when(done, "processed").otherwise("pending").alias("status"), F.col("t").alias("processed_at"))

    @cached_property
    def hourly_pnl(self) -> DataFrame:
        """Closed-form hourly PnL per user: signed quote volume, sells realised, buys unrealised."""
        t = self.trades
        sign = F.when(F.col("is_buyer"), -F.col("quote_qty")).otherwise(F.col("quote_qty"))
        return t.groupBy((F.col("ts") - F.col("ts") % 3600).alias("bucket"), "user_id").agg(
            F.round(F.sum(sign), 2).alias("total_pnl"),
            F.round(F.sum(F.when(~F.col("is_buyer"), F.col("quote_qty")).otherwise(0.0)), 2).alias("total_realized_pnl"),
            F.round(F.sum(F.when(F.col("is_buyer"), -F.col("quote_qty")).otherwise(0.0)), 2).alias("total_unrealized_pnl"),
            F.count(F.lit(1)).alias("trades_count"), F.round(F.sum("quote_qty"), 2).alias("volume_traded"))

    @cached_property
    def positions(self) -> DataFrame:
        """Closed-form positions per (user, symbol) for the query tests; the fold is tested by hand cases."""
        signed = F.when(F.col("is_buyer"), F.col("quantity")).otherwise(-F.col("quantity"))
        sold = F.when(~F.col("is_buyer"), F.col("quote_qty")).otherwise(0.0)
        bought = F.when(F.col("is_buyer"), F.col("quote_qty")).otherwise(0.0)
        return self.trades.groupBy("user_id", "symbol").agg(
            F.sum(signed).alias("quantity"), F.round(F.avg("price") + F.lit(1e-9), 4).alias("avg_cost"),
            F.round(F.sum(sold) - F.sum(bought), 2).alias("realized_pnl"),
            F.round(F.sum(signed) * 0.5, 2).alias("unrealized_pnl"), F.max("ts").alias("updated_at"))
