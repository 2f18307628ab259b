"""Lending protocol: event log, positions, rates and the dashboard queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.functions.columns import (
    at_least, below, format_amount, format_bps, format_usd, plain_symbol, ratio, row_key, sum_if,
)
from tickforge.operators.keyed import latest_per_key

PACK = 1_000  # listed assets that meet a user at once
BROADCAST_ASSETS = 50_000  # some megabytes
RECOMMENDED = "USDC"  # fixed value


def lending_events_log(raw: DataFrame) -> DataFrame:
    """All actions in one log; a repayment counts interest, rows sharing an id are summed."""
    amount = F.when(F.col("action") == "REPAY", F.col("amount") + F.col("interest")).otherwise(F.col("amount"))
    rows = raw.select(
        row_key("chain_id", "tx_hash", "action", "user_id", "ts").alias("id"), "chain_id", "action", "user_id",
        "token", F.when(F.col("action") == "LIQUIDATE", F.col("debt_token")).alias("debt_token"),
        F.when(F.col("action") == "LIQUIDATE", F.col("liquidator")).alias("liquidator"),
        amount.alias("amount"), "ts", "tx_hash", "seq")
    return rows.groupBy("id", "chain_id", "action", "user_id", "token", "debt_token", "liquidator", "ts", "tx_hash").agg(
        F.sum("amount").alias("amount"), F.max("seq").alias("seq"))


def _is(action: str):
    return F.col("action") == action


def lending_positions(events: DataFrame) -> DataFrame:
    """Collateral and debt accumulated per (user, token)."""
    return events.filter(F.col("action").isin("SUPPLY", "BORROW")).groupBy("chain_id", "user_id", "token").agg(
        sum_if(_is("SUPPLY"), "amount").alias("collateral_amount"),
        sum_if(_is("BORROW"), "amount").alias("debt_amount"), F.max("ts").alias("last_updated"))


def user_lending_stats(events: DataFrame) -> DataFrame:
    n = lambda a: F.count(F.when(_is(a), 1))
    return events.groupBy("chain_id", "user_id").agg(
        sum_if(_is("SUPPLY"), "amount").alias("total_supplied"), sum_if(_is("BORROW"), "amount").alias("total_borrowed"),
        sum_if(_is("REPAY"), "amount").alias("total_repaid"), sum_if(_is("WITHDRAW"), "amount").alias("total_withdrawn"),
        n("LIQUIDATE").alias("total_liquidations"), sum_if(_is("LIQUIDATE"), "amount").alias("total_liquidated_amount"),
        F.min("ts").alias("first_activity"), F.max("ts").alias("last_activity"))


def lending_balance_effect(events: DataFrame) -> DataFrame:
    """Effect on balances: borrow and withdraw subtract, repay adds, the last supply sets the lock."""
    signed = (F.when(_is("REPAY"), F.col("amount")).when(F.col("action").isin("BORROW", "WITHDRAW"), -F.col("amount"))
              .otherwise(F.lit(0)))
    return events.filter(~_is("LIQUIDATE")).groupBy("chain_id", "user_id", "token").agg(
        F.sum(signed).alias("d_amount"), F.max_by("amount", F.when(_is("SUPPLY"), F.col("seq"))).alias("locked_set"))


def synthetic_supply(tokens: DataFrame, events: DataFrame) -> DataFrame:
    """Total supply less withdrawals. ``tokens``: chain_id, token, total_supply."""
    out = events.filter(_is("WITHDRAW")).groupBy("chain_id", "token").agg(F.sum("amount").alias("withdrawn"))
    return tokens.join(out, ["chain_id", "token"], "left").select(
        "chain_id", "token", (F.col("total_supply") - F.coalesce("withdrawn", F.lit(0))).alias("total_supply"))


def liquidations_table(raw: DataFrame) -> DataFrame:
    """Liquidation log; the bonus is fixed at 1000 basis points, fee and price are not reported."""
    return raw.filter(_is("LIQUIDATE")).select(
        row_key("chain_id", "tx_hash", "user_id", "ts").alias("id"), "chain_id", F.col("user_id").alias("liquidated_user"),
        "liquidator", F.col("token").alias("collateral_token"), "debt_token", F.col("amount").alias("debt_to_cover"),
        F.lit(1000).alias("liquidation_bonus"), F.lit(0).alias("liquidation_fee"), F.lit(0).alias("price"), "ts", "tx_hash")


def oracle_price_log(events: DataFrame, source: str = "CHAINLINK", decimals: int = 18) -> DataFrame:
    """Price log keyed by (chain, token, time) with defaults for source and decimals."""
    rows = events.select(
        row_key("chain_id", "token", "ts").alias("id"), "chain_id", "token", "price",
        F.coalesce("source", F.lit(source)).alias("source"), F.coalesce("decimals", F.lit(decimals)).alias("decimals"),
        "ts", "seq")
    return latest_per_key(rows, ["id"], "seq")


def asset_config_state(events: DataFrame) -> DataFrame:
    """Latest risk configuration per token, 18-decimal fractions turned into basis points."""
    bps = lambda c: F.expr(f"cast({c} div cast(100000000000000 as decimal(38,0)) as int)").alias(c)
    rows = latest_per_key(events, ["chain_id", "token"], "seq")
    return rows.select("chain_id", "token", bps("collateral_factor"), bps("liquidation_threshold"),
                       bps("liquidation_bonus"), bps("reserve_factor"), "ts", F.lit(True).alias("is_active"))


def pool_lending_rates(configs: DataFrame) -> DataFrame:
    """Base supply and borrow rate (basis points) by collateral-factor band, reserve share on top."""
    cf = "collateral_factor"
    return configs.select(
        "chain_id", "token", at_least(cf, [(8000, 150), (7500, 250), (7000, 350)], 500).alias("supply_rate"),
        (at_least(cf, [(8000, 400), (7500, 600), (7000, 800)], 1200) + F.col("reserve_factor") / 10.0).alias("borrow_rate"),
        F.col("ts").alias("last_updated"))


def _with_tokens(df: DataFrame, tokens: DataFrame) -> DataFrame:
    info = tokens.select(F.lower("address").alias("_a"), "chain_id", "symbol", "decimals")
    return df.withColumn("_a", F.lower("token")).join(info, ["_a", "chain_id"], "left").drop("_a").withColumn(
        "asset", plain_symbol(F.coalesce("symbol", F.lit("UNKNOWN")))).withColumn(
        "decimals", F.coalesce("decimals", F.lit(18))).drop("symbol")


def lending_supplies(positions: DataFrame, rates: DataFrame, tokens: DataFrame) -> DataFrame:
    """Supplied positions with token info, value and rate."""
    p = _with_tokens(positions.filter("collateral_amount > 0"), tokens).join(
        rates.select("chain_id", "token", "supply_rate"), ["chain_id", "token"], "left")
    amount = F.col("collateral_amount") / F.pow(F.lit(10.0), F.col("decimals"))
    rate = F.coalesce("supply_rate", F.lit(0))
    return p.select("chain_id", "user_id", "token", "asset", amount.alias("supplied"),
                    format_amount(amount).alias("supplied_text"), format_usd(amount).alias("value_text"),
                    rate.cast("double").alias("rate_bps"), format_bps(rate).alias("apy"))


def lending_borrows(positions: DataFrame, rates: DataFrame, tokens: DataFrame,
                    health: DataFrame | None = None) -> DataFrame:
    """Borrowed positions; the health bands appear only for users with a health factor."""
    p = _with_tokens(positions.filter("debt_amount > 0"), tokens).join(
        rates.select("chain_id", "token", "borrow_rate"), ["chain_id", "token"], "left")
    if health is None:
        p = p.withColumn("health_factor", F.lit(None).cast("double"))
    else:
        p = p.join(health.select("user_id", "health_factor"), "user_id", "left")
    amount = F.col("debt_amount") / F.pow(F.lit(10.0), F.col("decimals"))
    rate = F.coalesce("borrow_rate", F.lit(0.0))
    band = F.when(F.col("health_factor").isNotNull(), below("health_factor", [(1.5, "danger"), (2.0, "warning")], "safe"))
    return p.select("chain_id", "user_id", "token", "asset", amount.alias("borrowed"),
                    format_usd(amount).alias("debt_text"), rate.alias("rate_bps"), format_bps(rate).alias("apy"),
                    "health_factor", band.alias("health_status"))


def _with_assets(users: DataFrame, configs: DataFrame, most: int = BROADCAST_ASSETS) -> DataFrame:
    """Every user with every listed asset as ``c``, which is what the listings are.

    Assets meet users in packs. Up to ``most`` assets the packs are broadcast; beyond that they are dealt out with a salt, so
    that neither the users of a pack nor the packs of a user meet in one task.
    """
    listed = configs.filter("is_active")
    n = listed.count()
    parts = n // PACK + 1
    packs = listed.groupBy(F.pmod(F.xxhash64("chain_id", "token"), F.lit(parts)).cast("int").alias("part")).agg(F.collect_list(F.struct(*configs.columns)).alias("pack"))
    each = users.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    if n <= most:
        joined = each.join(F.broadcast(packs), "part")
    else:
        salts = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        packs = packs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = each.withColumn("salt", F.pmod(F.xxhash64("user_id"), F.lit(salts)).cast("int")).join(packs, ["part", "salt"])
    return joined.select(*users.columns, F.explode("pack").alias("c"))


def lending_available_to_supply(users: DataFrame, configs: DataFrame, supplies: DataFrame, rates: DataFrame, tokens: DataFrame,
                                most: int = BROADCAST_ASSETS) -> DataFrame:
    """Every listed asset per user: its name, rate and what the user already supplies of it."""
    shown = _with_tokens(configs, tokens).join(rates.select("chain_id", "token", "supply_rate"), ["chain_id", "token"], "left").select(
        "chain_id", "token", "asset", format_bps(F.coalesce("supply_rate", F.lit(0))).alias("apy"), "is_active")
    offers = _with_assets(users.select("user_id").distinct(), shown, most).select("user_id", "c.chain_id", "c.token", "c.asset", "c.apy")
    return offers.join(supplies.select("chain_id", "user_id", "token", "supplied"), ["chain_id", "user_id", "token"], "left").select(
        "chain_id", "user_id", "token", "asset", F.coalesce("supplied", F.lit(0.0)).alias("supplied"), "apy", F.lit(True).alias("can_supply"),
        (F.col("asset") == RECOMMENDED).alias("recommended"))


def borrowing_base(supplies: DataFrame) -> DataFrame:
    """Supplied value per user, summed exactly: the noise of a sum of floats would decide what is floored later.

    Sums that do not fit 28 digits before the point are sums of floats.
    """
    exact = F.col("supplied").try_cast("decimal(38,10)")
    fits = F.count(exact) == F.count("supplied")
    return supplies.groupBy("user_id").agg(
        F.coalesce(F.when(fits, F.try_sum(exact)).cast("double"), F.sum("supplied")).alias("collateral"))


def lending_available_to_borrow(supplies: DataFrame, configs: DataFrame, most: int = BROADCAST_ASSETS) -> DataFrame:
    """Borrowing power per user and listed asset: collateral value times loan-to-value, floored."""
    power = borrowing_base(supplies).filter("collateral > 0")
    ltv = F.col("c.collateral_factor") / 10000.0
    return _with_assets(power, configs, most).filter(ltv > 0).select(
        "user_id", "c.token", F.floor(F.col("collateral") * ltv).alias("available"), (ltv * 100).alias("collateral_factor"),
        (F.col("c.liquidation_threshold") / 100.0).alias("liquidation_threshold"))


def lending_summary(supplies: DataFrame, borrows: DataFrame) -> DataFrame:
    """Totals, value-weighted supply rate, worst health factor and 0.8 x collateral borrowing power."""
    s = supplies.groupBy("user_id").agg(
        F.sum("supplied").alias("total_supplied"), ratio(F.sum(F.col("rate_bps") * F.col("supplied")), F.sum("supplied")).alias("w"))
    b = borrows.groupBy("user_id").agg(F.sum("borrowed").alias("total_borrowed"), F.min("health_factor").alias("hf"))
    return s.join(b, "user_id", "full_outer").select(
        "user_id", F.coalesce("total_supplied", F.lit(0.0)).alias("total_supplied"),
        F.coalesce("total_borrowed", F.lit(0.0)).alias("total_borrowed"),
        (F.coalesce("w", F.lit(0.0)) / 100).alias("net_apy"), F.coalesce("hf", F.lit(999999.0)).alias("health_factor"),
        (F.coalesce("total_supplied", F.lit(0.0)) * 0.8).alias("borrowing_power"))
