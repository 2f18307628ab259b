"""Capital flow: signed trade flow, institutional and whale shares, deposits and withdrawals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import above, is_buy, ratio, ratio0, scaled, sum_if, time_order
from tickforge.functions.timeutil import (
    bucket, bucket_index, calendar_bucket, in_period, interval_seconds, period_start, spine, series_start,
)
from tickforge.plans.ledger import ledger_deltas
from tickforge.plans.volume import _among
from tickforge.plans.volume_etl import base_step, per_interval

FLOW_PERIODS = {"1h": 3600, "4h": 14400, "1d": 86400, "1w": 604800}
LARGE, WHALE, RETAIL = 10_000, 100_000, 1_000  # fixed values: trade-size bounds
LOOKBACK_PERIODS = 7


def capital_flow(trades: DataFrame, periods: dict[str, int] | None = None, institutional_volume: float = 1_000_000,
                 institutional_trades: int = 100) -> DataFrame:
    """Flow metrics per symbol, period type and bucket (stamped with the bucket end).

    Sums and prices are merged per (symbol, cell of the base step), which combine before the shuffle. Only what depends on
    the trader is kept per (symbol, trader, cell) and merged per (symbol, period, bucket, trader): volume and trades of
    both sides. A trader is institutional in a bucket when the trailing seven buckets, all symbols together, exceed both
    thresholds: a window over those sums.
    """
    keys = ["symbol", "period_type", "time_bucket"]
    periods = periods or FLOW_PERIODS
    q, buy, order = F.col("quote_qty"), is_buy(), time_order(trades)
    split = lambda cond: [sum_if(buy & cond, q), sum_if(~buy & cond, q)]
    named = {"inflow_volume": split(F.lit(True)), "large": split(q > LARGE), "whale": split(q > WHALE), "retail": split(q < RETAIL)}
    aggs = []
    for n, (i, o) in named.items():
        a, b = ("inflow_volume", "outflow_volume") if n == "inflow_volume" else (f"{n}_inflows", f"{n}_outflows")
        aggs += [i.alias(a), o.alias(b)]
    sums = ["inflow_volume", "outflow_volume", "large_inflows", "large_outflows", "whale_inflows", "whale_outflows",
            "retail_inflows", "retail_outflows"]
    cell = bucket("ts", base_step(periods)).alias("cell")
    wide = lambda cells: per_interval(cells, "cell", periods).withColumnRenamed("interval_type", "period_type")
    cells = trades.groupBy("symbol", cell).agg(
        *aggs, F.count(F.lit(1)).alias("n"),
        F.min_by("price", order).alias("open"), F.min(order).alias("first"), F.max_by("price", order).alias("close"), F.max(order).alias("last"))
    totals = wide(cells).groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums], F.sum("n").alias("trade_count"),
        F.min_by("open", "first").alias("open"), F.max_by("close", "last").alias("close"))
    theirs = ["bought", "sold", "buys", "sells", "n"]
    user_cells = trades.groupBy("symbol", "user_id", cell).agg(
        sum_if(buy, q).alias("bought"), sum_if(~buy, q).alias("sold"), F.count(F.when(buy, 1)).alias("buys"),
        F.count(F.when(~buy, 1)).alias("sells"), F.count(F.lit(1)).alias("n"))
    per_user = wide(user_cells).groupBy(*keys, "step", "user_id").agg(*[F.sum(c).alias(c) for c in theirs])
    trail = Window.partitionBy("user_id", "period_type").orderBy("slot").rangeBetween(1 - LOOKBACK_PERIODS, 0)
    per_user = per_user.withColumn("slot", F.floor(F.col("time_bucket") / F.col("step"))).withColumn(
        "inst", (F.sum(F.col("bought") + F.col("sold")).over(trail) > institutional_volume) & (F.sum("n").over(trail) > institutional_trades))
    traders = per_user.groupBy(*keys).agg(
        F.count(F.when(F.col("buys") > 0, 1)).alias("unique_inflow_addresses"),
        F.count(F.when(F.col("sells") > 0, 1)).alias("unique_outflow_addresses"),
        sum_if(F.col("inst"), F.col("bought") - F.col("sold")).alias("institutional_flow"))
    net = F.col("inflow_volume") - F.col("outflow_volume")
    t, u = totals.alias("t"), traders.alias("u")  # a missing symbol is a group as well
    flows = t.join(u, [F.col(f"t.{k}").eqNullSafe(F.col(f"u.{k}")) for k in keys]).select(
        "t.*", "unique_inflow_addresses", "unique_outflow_addresses", "institutional_flow")
    flows = flows.withColumn("net_flow", net).withColumn("volume", F.col("inflow_volume") + F.col("outflow_volume"))
    flows = flows.withColumn("market", F.sum("volume").over(Window.partitionBy("period_type", "time_bucket")))
    whales = F.col("whale_inflows") + F.col("whale_outflows")
    large = F.col("large_inflows") + F.col("large_outflows")
    nf, v = F.col("net_flow"), F.col("volume")
    return flows.filter(v > 0).select(
        *keys, "net_flow", *sums, "institutional_flow", F.lit(0.0).alias("dex_flow"), nf.alias("cex_flow"),
        "unique_inflow_addresses", "unique_outflow_addresses",
        ratio0(F.greatest(whales, large), v).alias("flow_concentration"), (ratio0("trade_count", v) * 1000).alias("flow_velocity"),
        F.when(F.col("open") > 0, F.signum(F.col("close") - F.col("open")) * F.signum(F.round(nf, 6))).otherwise(0.0).alias("price_correlation"),
        F.when(nf > v * 0.1, "bullish").when(nf < -v * 0.1, "bearish").otherwise("neutral").alias("flow_momentum"),
        (ratio0(v, "market") * 100).alias("dominance_score"),
        (F.col("institutional_flow") + F.col("whale_inflows") - F.col("whale_outflows")).alias("smart_money_flow"),
        F.when(F.abs(nf) > v * 0.3, "strong").when(F.abs(nf) > v * 0.1, "medium").otherwise("weak").alias("flow_strength"))


def _recent(flow: DataFrame, period: str, hours: int, as_of: int, symbols: list[str] | None = None) -> DataFrame:
    f = flow.filter((F.col("period_type") == period) & F.col("time_bucket").between(as_of - hours * 3600, as_of))
    return _among(f, symbols)


def capital_flow_summary(flow: DataFrame, period: str, hours: int, as_of: int, symbols: list[str] | None = None) -> DataFrame:
    return _recent(flow, period, hours, as_of, symbols).select(
        "symbol", "time_bucket", "net_flow", "flow_momentum", "flow_strength", "smart_money_flow",
        (F.col("whale_inflows") - F.col("whale_outflows")).alias("whale_net_flow"), "institutional_flow").orderBy(
        F.col("time_bucket").desc(), F.abs("net_flow").desc(), "symbol")


def top_capital_flow_symbols(flow: DataFrame, period: str, days: int, as_of: int, flow_type: str = "net",
                             limit: int = 20) -> DataFrame:
    agg = _recent(flow, period, days * 24, as_of).groupBy("symbol").agg(
        F.sum("net_flow").alias("total_net_flow"), F.mode("flow_strength", True).alias("avg_flow_strength"),
        F.sum("smart_money_flow").alias("smart_money_total"),
        (ratio0(F.sum(F.col("whale_inflows") + F.col("whale_outflows")), F.sum(F.col("inflow_volume") + F.col("outflow_volume"))) * 100).alias("whale_dominance"),
        ratio0(F.stddev_samp("net_flow"), F.avg(F.abs("net_flow"))).alias("flow_consistency"))
    net = F.col("total_net_flow")
    key = {"inflow": F.greatest(net, F.lit(0.0)), "outflow": F.greatest(-net, F.lit(0.0)),
           "smart_money": F.abs("smart_money_total")}.get(flow_type, F.abs(net))
    return agg.orderBy(key.desc(), "symbol").limit(limit)


def capital_flow_alerts(flow: DataFrame, period: str, hours: int, as_of: int, multiplier: float = 3.0,
                        baseline_days: int = 7, min_points: int = 10) -> DataFrame:
    """Buckets whose net flow exceeds ``multiplier`` times the symbol's mean absolute flow."""
    base = _recent(flow, period, baseline_days * 24, as_of).groupBy("symbol").agg(
        F.avg(F.abs("net_flow")).alias("typical"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_points)
    f = _recent(flow, period, hours, as_of).join(base, "symbol").filter(F.abs("net_flow") > F.col("typical") * multiplier)
    return f.select("symbol", "time_bucket", "net_flow", ratio0(F.abs("net_flow"), "typical").alias("flow_magnitude"),
                    F.when(F.col("net_flow") > 0, "Unusual Inflow").otherwise("Unusual Outflow").alias("alert_type"),
                    "smart_money_flow")


def capital_flow_list(flow: DataFrame, period: str, hours: int, as_of: int, limit: int = 100,
                      symbols: list[str] | None = None) -> DataFrame:
    return _recent(flow, period, hours, as_of, symbols).orderBy(
        F.col("time_bucket").desc(), F.abs("net_flow").desc(), "symbol").limit(limit)


def inflow_series(ledger: DataFrame, trades: DataFrame, period: str, interval: str, as_of: int) -> DataFrame:
    """Per spine bucket: balance increases, traded volume, change of deposits and distinct depositors.

    The market trend compares the mean traded volume of the second half of the period with the first.
    """
    step = interval_seconds(interval)
    start = min(series_start(rows, period, as_of, step) for rows in (ledger, trades))
    idx = bucket_index("ts", start, step).alias("idx")
    ups = ledger_deltas(ledger).filter((F.col("d_amount") > 0) & in_period("ts", period, as_of)).groupBy(idx).agg(
        F.sum("d_amount").alias("deposits"), F.count_distinct("user_id").alias("unique_depositors"))
    vol = trades.filter(in_period("ts", period, as_of)).groupBy(idx).agg(F.sum("quote_qty").alias("trading_volume"))
    line = spine(trades.sparkSession, start, as_of, step)
    half = (line.agg(F.max("idx")).scalar() / 2)
    j = line.join(ups, "idx", "left").join(vol, "idx", "left").select(
        "idx", "timestamp", F.coalesce("deposits", F.lit(0)).alias("deposits"),
        F.coalesce("trading_volume", F.lit(0.0)).alias("trading_volume"),
        F.coalesce("unique_depositors", F.lit(0)).alias("unique_depositors"))
    early, late = F.avg(F.when(F.col("idx") < half, F.col("trading_volume"))), F.avg(F.when(F.col("idx") >= half, F.col("trading_volume")))
    market = j.agg(F.struct(F.avg("trading_volume").alias("mean"), F.max("trading_volume").alias("peak"),
                            F.when(late > early, "positive").when(late < early, "negative").otherwise("neutral").alias("trend")).alias("m"))
    w = Window.orderBy("timestamp")
    return j.withColumn("m", market.scalar()).select(
        "timestamp", (F.col("deposits") + F.col("trading_volume")).alias("total_inflow"), "deposits", "trading_volume",
        (F.col("deposits") - F.lag("deposits", 1, 0).over(w)).alias("net_flow"), "unique_depositors",
        F.col("m.mean").alias("avg_inflow"), F.col("m.peak").alias("peak_inflow"), F.col("m.trend").alias("trend"))


def _flow_aggs() -> list:
    return [sum_if(is_buy(), "quote_qty").alias("total_inflow"), sum_if(~is_buy(), "quote_qty").alias("total_outflow"),
            F.sum("quote_qty").alias("total_volume"), F.count(F.lit(1)).alias("trade_count"),
            F.count_distinct("user_id").alias("unique_traders"), F.count(F.when(is_buy(), 1)).alias("buy_trades"),
            F.count(F.when(~is_buy(), 1)).alias("sell_trades"), F.avg("quote_qty").alias("avg_trade_size"),
            F.min("quote_qty").alias("min_trade_size"), F.max("quote_qty").alias("max_trade_size"),
            F.min("ts").alias("first_trade_time"), F.max("ts").alias("last_trade_time")]


def flow_direction(net, volume, strong: float):
    return (F.when(net > volume * strong, "strong_inflow").when(net > 0, "inflow")
            .when(net < -volume * strong, "strong_outflow").when(net < 0, "outflow").otherwise("balanced"))


def symbol_flow_series(trades: DataFrame, period: str, interval: str, as_of: int, symbols: list[str] | None = None,
                       strong: float = 0.1) -> DataFrame:
    start, step = period_start(period, as_of), interval_seconds(interval)
    t = _among(trades.filter(in_period("ts", period, as_of)), symbols)
    f = t.groupBy("symbol", bucket_index("ts", start, step).alias("idx")).agg(*_flow_aggs()).withColumn(
        "net_flow", F.round(F.col("total_inflow") - F.col("total_outflow"), 6))
    return f.select("symbol", (F.lit(start).cast("long") + F.col("idx") * step).alias("timestamp"), "total_inflow",
                    "total_outflow", "total_volume", "net_flow", "trade_count", "unique_traders", "buy_trades",
                    "sell_trades", "avg_trade_size", "min_trade_size", "max_trade_size",
                    flow_direction(F.col("net_flow"), F.col("total_volume"), strong).alias("flow_direction"))


def symbol_flow_summary(trades: DataFrame, period: str, as_of: int, symbols: list[str] | None = None,
                        strong: float = 0.2) -> DataFrame:
    t = _among(trades.filter(in_period("ts", period, as_of)), symbols)
    f = t.groupBy("symbol").agg(*_flow_aggs()).withColumn("net_flow", F.round(F.col("total_inflow") - F.col("total_outflow"), 6))
    return f.withColumn("flow_direction", flow_direction(F.col("net_flow"), F.col("total_volume"), strong)) \
        .withColumn("flow_percentage", ratio("net_flow", "total_volume") * 100) \
        .withColumn("activity_level", above("trade_count", [(1000, "high"), (100, "medium")], "low")) \
        .withColumn("avg_inflow_per_trade", ratio("total_inflow", "buy_trades")) \
        .withColumn("avg_outflow_per_trade", ratio("total_outflow", "sell_trades"))


def _scaled_movements(rows: DataFrame, currencies: DataFrame, period: str, as_of: int, symbol: str | None) -> DataFrame:
    c = currencies.select(F.lower("address").alias("_a"), "chain_id", "symbol", "decimals")
    m = rows.filter(in_period("ts", period, as_of)).withColumn("_a", F.lower("currency")).join(c, ["_a", "chain_id"], "left")
    m = m if symbol in (None, "all") else m.filter(F.col("symbol") == symbol)
    return m.withColumn("amount_h", scaled("amount", F.coalesce("decimals", F.lit(18))))


def movement_series(rows: DataFrame, currencies: DataFrame, period: str, interval: str, as_of: int,
                    symbol: str | None = None) -> DataFrame:
    """Deposits or withdrawals per bucket, scaled by the currency's own decimals; hourly for a day or on request."""
    unit = "hour" if period == "24h" or interval == "hourly" else "day"
    return _scaled_movements(rows, currencies, period, as_of, symbol).groupBy(calendar_bucket("ts", unit).alias("timestamp")).agg(
        F.sum("amount_h").alias("total"), F.count(F.lit(1)).alias("movements"), F.count_distinct("user_id").alias("unique_users"))


def movement_summary(rows: DataFrame, currencies: DataFrame, period: str, interval: str, as_of: int,
                     symbol: str | None = None) -> DataFrame:
    unit = "hour" if period == "24h" or interval == "hourly" else "day"
    m = _scaled_movements(rows, currencies, period, as_of, symbol)
    return m.agg(
        F.coalesce(F.sum("amount_h"), F.lit(0.0)).alias("total"), F.count(F.lit(1)).alias("movements"),
        F.count_distinct("user_id").alias("unique_users"),
        ratio0(F.sum("amount_h"), F.count_distinct(calendar_bucket("ts", unit))).alias("avg_per_bucket"))


def _movement_report(rows: DataFrame, currencies: DataFrame, period: str, interval: str, as_of: int) -> DataFrame:
    """Totals, mean size and the peak bucket."""
    peak = movement_series(rows, currencies, period, interval, as_of).agg(F.max("total")).scalar()
    return movement_summary(rows, currencies, period, interval, as_of).withColumn(
        "peak_bucket", F.coalesce(peak, F.lit(0.0))).withColumn("avg_size", ratio0("total", "movements"))


def inflow_report(deposits: DataFrame, currencies: DataFrame, period: str, interval: str, as_of: int) -> DataFrame:
    """Deposit report; the trend follows the number of deposits, the market stage the total."""
    return _movement_report(deposits, currencies, period, interval, as_of).withColumn(
        "trend", above("movements", [(10, "positive"), (5, "neutral")], "negative")).withColumn(
        "stage", above("total", [(1_000_000, "strong"), (100_000, "moderate")], "early"))


def outflow_report(withdrawals: DataFrame, currencies: DataFrame, period: str, interval: str, as_of: int) -> DataFrame:
    """Withdrawal report with trend, risk and activity class by the number of withdrawals."""
    return _movement_report(withdrawals, currencies, period, interval, as_of).withColumn(
        "trend", above("movements", [(10, "declining"), (5, "stable")], "low")).withColumn(
        "risk_level", above("movements", [(20, "high")], "low")).withColumn(
        "activity", above("movements", [(20, "high"), (10, "moderate"), (0, "low")], "none"))
