"""User activity, growth and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.functions.columns import at_least, ratio, ratio0, sum_if
from tickforge.functions.timeutil import (
    bucket, bucket_index, calendar_bucket, in_period, interval_seconds, period_start, series_start, spine,
)
from tickforge.plans.volume import _among


def _along_time():
    """Order of the bucket series; one row per time bucket, so its length is bounded by the time span."""
    return Window.orderBy("timestamp")


def _up_to_now():
    return _along_time().rowsBetween(Window.unboundedPreceding, 0)


def daily_user_activity(trades: DataFrame, commission_rate: float = 0.002) -> DataFrame:
    return trades.groupBy(bucket("ts", 86400).alias("bucket"), "user_id").agg(
        F.count(F.lit(1)).alias("trades_count"), F.sum("quote_qty").alias("total_volume"),
        F.count_distinct("symbol").alias("symbols_traded"),
        (F.sum("quote_qty") * commission_rate).alias("total_fees_paid"))


def first_trades(trades: DataFrame) -> DataFrame:
    return trades.groupBy("user_id").agg(F.min("ts").alias("first_seen"))


def daily_new_users(trades: DataFrame) -> DataFrame:
    return first_trades(trades).groupBy(bucket("first_seen", 86400).alias("bucket")).agg(
        F.count(F.lit(1)).alias("new_users_count"))


def cumulative_users(users: DataFrame, period: str, interval: str, as_of: int) -> DataFrame:
    """New users per bucket, running total in the period and the period's share of all users."""
    inside = in_period("first_seen", period, as_of)
    totals = users.agg(F.struct(F.count(F.lit(1)).alias("everyone"), F.count(F.when(inside, 1)).alias("n")).alias("t"))
    per = users.filter(inside).groupBy(calendar_bucket("first_seen", interval).alias("timestamp")).agg(
        F.count(F.lit(1)).alias("new_users"))
    return per.withColumn("cumulative_users", F.sum("new_users").over(_up_to_now())).withColumn("t", totals.scalar()).select(
        "timestamp", "new_users", "cumulative_users", F.col("t.everyone").alias("total_users"),
        F.col("t.n").alias("new_users_in_period"), (ratio0("t.n", "t.everyone") * 100).alias("growth_rate"))


def cumulative_new_traders(trades: DataFrame, period: str, interval: str, as_of: int) -> DataFrame:
    """Gap-filled spine of new traders, running total and growth over the previous bucket."""
    step = interval_seconds(interval)
    start = series_start(trades, period, as_of, step)
    fresh = first_trades(trades).filter(in_period("first_seen", period, as_of)).groupBy(
        bucket_index("first_seen", start, step).alias("idx")).agg(F.count(F.lit(1)).alias("n"))
    line = spine(trades.sparkSession, start, as_of, step).join(fresh, "idx", "left").select(
        "timestamp", F.coalesce("n", F.lit(0)).alias("new_users"))
    run = line.withColumn("cumulative_users", F.sum("new_users").over(_up_to_now())).withColumn(
        "prev", F.lag("cumulative_users").over(_along_time()))
    return run.select("timestamp", "new_users", "cumulative_users", F.when(
        F.col("prev") > 0, (F.col("cumulative_users") - F.col("prev")) * 100.0 / F.col("prev")).otherwise(0.0).alias("growth_rate"))


def cumulative_new_users_rollup(new_users: DataFrame, period: str, as_of: int) -> DataFrame:
    """From the daily new-user table: running total, growth and the period's growth per day of span."""
    d = new_users.filter(in_period("bucket", period, as_of)).select(F.col("bucket").alias("timestamp"), F.col("new_users_count").alias("new_users"))
    span = d.agg(F.struct(F.sum("new_users").alias("n"), F.avg("new_users").alias("mean"),
                          ((F.max("timestamp") - F.min("timestamp")) / 86400).alias("days")).alias("s"))
    run = d.withColumn("cumulative_users", F.sum("new_users").over(_up_to_now())).withColumn(
        "prev", F.lag("cumulative_users", 1, 0).over(_along_time()))
    return run.withColumn("s", span.scalar()).select(
        "timestamp", "new_users", "cumulative_users",
        F.when(F.col("prev") > 0, (F.col("cumulative_users") - F.col("prev")) * 100.0 / F.col("prev")).otherwise(0.0).alias("growth_rate"),
        F.col("s.n").alias("new_users_in_period"), F.col("s.mean").alias("avg_daily_growth"),
        ratio("s.n", "s.days").alias("growth_per_day"))


def mv_user_growth(trades: DataFrame, as_of: int, period: str = "90d") -> DataFrame:
    """Daily actives with the running sum of actives and, next to it, the true cumulative distinct users."""
    t = trades.filter(in_period("ts", period, as_of))
    seen = t.groupBy("user_id", bucket("ts", 86400).alias("timestamp")).agg(F.count(F.lit(1)).alias("n"))
    first = seen.groupBy("user_id").agg(F.min("timestamp").alias("timestamp")).groupBy("timestamp").agg(
        F.count(F.lit(1)).alias("fresh"))
    daily = seen.groupBy("timestamp").agg(F.count(F.lit(1)).alias("daily_active_users"), F.sum("n").alias("daily_trades"))
    return daily.join(first, "timestamp", "left").select(
        "timestamp", "daily_active_users", "daily_trades", F.sum("daily_active_users").over(_up_to_now()).alias("sum_of_daily_actives"),
        F.sum(F.coalesce("fresh", F.lit(0))).over(_up_to_now()).alias("cumulative_users"))


def _active(trades: DataFrame, keys: list[str], period: str, as_of: int, interval: str) -> DataFrame:
    """(keys, bucket) activity inside the period with the key's first trade over all history.

    One pass: history before the period collapses into a single bucket per key.
    """
    step = interval_seconds(interval)
    start = series_start(trades, period, as_of, step)
    idx = F.greatest(bucket_index("ts", start, step), F.lit(-1).cast("long"))
    per = trades.filter(F.col("ts") <= as_of).groupBy(*keys, idx.alias("idx")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("quote_qty").alias("volume"), F.min("ts").alias("first_here"))
    return per.withColumn("first_seen", F.min("first_here").over(Window.partitionBy(*keys))).filter("idx >= 0").withColumn(
        "begins", F.lit(start).cast("long") + F.col("idx") * step)


def _people() -> list:
    new = F.col("first_seen") >= F.col("begins")
    return [F.count(F.lit(1)).alias("unique_traders"), F.count(F.when(new, 1)).alias("new_traders"),
            F.count(F.when(~new, 1)).alias("returning_traders")]


def unique_traders_series(trades: DataFrame, period: str, interval: str, as_of: int, min_trades: int = 1) -> DataFrame:
    """Unique, new and returning traders per bucket; new means no trade before the bucket, in all history.

    Buckets with trades but fewer than ``min_trades`` are dropped, empty buckets are kept.
    """
    step = interval_seconds(interval)
    start = series_start(trades, period, as_of, step)
    per = _active(trades, ["user_id"], period, as_of, interval).groupBy("idx").agg(*_people(), F.sum("n").alias("n"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    line = spine(trades.sparkSession, start, as_of, step).join(per, "idx", "left")
    return line.filter((z("n") >= min_trades) | (z("n") == 0)).select(
        "timestamp", z("unique_traders").alias("unique_traders"), z("new_traders").alias("new_traders"),
        z("returning_traders").alias("returning_traders"),
        (ratio0(z("returning_traders"), z("unique_traders")) * 100).alias("retention_rate"))


def unique_traders_summary(trades: DataFrame, period: str, as_of: int, min_trades: int = 1) -> DataFrame:
    t = trades.filter(in_period("ts", period, as_of))
    days = t.groupBy("user_id", bucket("ts", 86400).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    peak = days.groupBy("day").agg(F.count(F.lit(1)).alias("c")).agg(F.max("c"))
    per_user = days.groupBy("user_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("days")).filter(F.col("n") >= min_trades)
    return per_user.agg(
        F.count(F.lit(1)).alias("total_unique_traders"), F.avg("days").alias("avg_active_days"),
        (F.avg(F.when(F.col("days") > 1, 1.0).otherwise(0.0)) * 100).alias("overall_retention_rate")
    ).withColumn("peak_daily_traders", peak.scalar())


def unique_traders_lag(activity: DataFrame, period: str, interval: str, as_of: int, min_trades: int = 1) -> DataFrame:
    """From the daily activity table: returning means an earlier active day inside the window."""
    w = Window.partitionBy("user_id").orderBy("bucket")
    a = activity.filter(in_period("bucket", period, as_of) & (F.col("trades_count") >= min_trades)).withColumn(
        "before", F.lag("bucket").over(w))
    per = a.groupBy(calendar_bucket("bucket", interval).alias("timestamp")).agg(
        F.count_distinct("user_id").alias("unique_traders"),
        F.count_distinct(F.when(F.col("before").isNull(), F.col("user_id"))).alias("new_traders"),
        F.count_distinct(F.when(F.col("before").isNotNull(), F.col("user_id"))).alias("returning_traders"))
    daily = a.groupBy("bucket").agg(F.count_distinct("user_id").alias("c")).agg(
        F.struct(F.avg("c").alias("mean"), F.max("c").alias("peak")).alias("d"))
    return per.withColumn("d", daily.scalar()).select(
        "timestamp", "unique_traders", "new_traders", "returning_traders",
        (ratio0("returning_traders", "unique_traders") * 100).alias("retention_rate"),
        F.col("d.mean").alias("avg_daily_active_traders"), F.col("d.peak").alias("peak_daily_traders"))


def symbol_unique_traders_series(trades: DataFrame, period: str, interval: str, as_of: int,
                                 symbols: list[str] | None = None, min_trades: int = 1) -> DataFrame:
    """Symbol x bucket version with trades and volume; ``min_trades=0`` keeps empty cells."""
    step, t = interval_seconds(interval), _among(trades, symbols)
    start = series_start(t, period, as_of, step)
    per = _active(t, ["symbol", "user_id"], period, as_of, interval).groupBy("symbol", "idx").agg(
        *_people(), F.sum("n").alias("total_trades"), F.sum("volume").alias("total_volume"))
    if min_trades == 0:
        last = max(0, (as_of - start) // step)
        cells = t.select("symbol").distinct().withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
        per = cells.join(per, ["symbol", "idx"], "left")
    z = lambda c, v=0: F.coalesce(F.col(c), F.lit(v)).alias(c)
    return per.select(
        "symbol", (F.lit(start).cast("long") + F.col("idx") * step).alias("timestamp"), z("unique_traders"), z("new_traders"),
        z("returning_traders"), z("total_trades"), z("total_volume", 0.0),
        F.coalesce(ratio("returning_traders", "unique_traders") * 100, F.lit(0.0)).alias("retention_rate"))


def symbol_unique_traders_summary(trades: DataFrame, period: str, as_of: int, symbols: list[str] | None = None,
                                  min_trades: int = 1) -> DataFrame:
    """Per symbol: traders, new and returning by all history, averages and activity level."""
    start = period_start(period, as_of)
    t = _among(trades, symbols)
    first = t.groupBy("symbol", "user_id").agg(F.min("ts").alias("first_seen"))
    per_user = t.filter(in_period("ts", period, as_of)).groupBy("symbol", "user_id", bucket("ts", 86400).alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("quote_qty").alias("v"), F.min("ts").alias("a"), F.max("ts").alias("z")
    ).groupBy("symbol", "user_id").agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("days"), F.sum("v").alias("v"), F.min("a").alias("a"),
        F.max("z").alias("z")).filter(F.col("n") >= min_trades).join(first, ["symbol", "user_id"])
    old = F.col("first_seen") < start
    m = per_user.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("unique_traders"), F.count(F.when(~old, 1)).alias("new_traders"),
        F.count(F.when(old, 1)).alias("returning_traders"), F.avg("days").alias("avg_active_days"),
        F.avg("n").alias("avg_trades_per_trader"), F.sum("v").alias("total_volume"), F.avg("v").alias("avg_volume_per_trader"),
        F.min("a").alias("first_trade_time"), F.max("z").alias("last_trade_time"))
    return m.withColumn("activity_level", at_least("unique_traders", [(100, "very_high"), (50, "high"), (20, "medium"), (5, "low")], "very_low")) \
        .withColumn("retention_rate", ratio0("returning_traders", "unique_traders") * 100)


def top_users_by_trades(activity: DataFrame, period: str, as_of: int, limit: int = 50, offset: int = 0) -> DataFrame:
    per = activity.filter(in_period("bucket", period, as_of)).groupBy("user_id").agg(
        F.sum("trades_count").alias("trade_count"), F.sum("total_volume").alias("total_volume"),
        F.count_distinct("bucket").alias("active_days"), F.max("bucket").alias("last_trade_day"))
    total = per.agg(F.count(F.lit(1))).scalar()
    return per.orderBy(F.col("trade_count").desc(), "user_id").offset(offset).limit(limit).withColumn("total", total)


def user_activity_hourly(trades: DataFrame, positions: DataFrame) -> DataFrame:
    """Activity of every user and hour: trades against the symbol's mean price of that hour, full-outer with the
    PnL of positions updated in the hour, plus the activity and risk scores. Stamped with the hour's end."""
    t = trades.filter(F.col("user_id").isNotNull()).withColumn("hour", bucket("ts", 3600))
    mean = t.groupBy("symbol", "hour").agg(F.avg("price").alias("mean_price"))
    edge = F.col("price") - F.col("mean_price")
    won = F.when(F.col("is_buyer"), edge).otherwise(-edge) > 0
    gain = F.abs(edge * F.col("quantity"))
    stats = t.join(mean, ["symbol", "hour"]).groupBy("user_id", "hour").agg(
        F.count(F.lit(1)).alias("trades_count"), F.sum("quote_qty").alias("total_volume"),
        F.avg("quote_qty").alias("avg_trade_size"), F.max("quote_qty").alias("largest_trade"),
        F.array_sort(F.collect_set("symbol")).alias("symbols_traded"),
        F.count(F.when(won, 1)).alias("winning_trades"), F.count(F.when(~won, 1)).alias("losing_trades"),
        sum_if(won, gain).alias("total_trades_profit"), sum_if(~won, gain).alias("total_trades_loss"))
    pnl = positions.groupBy("user_id", bucket("updated_at", 3600).alias("hour")).agg(
        F.sum("realized_pnl").alias("realized_pnl"), F.sum("unrealized_pnl").alias("unrealized_pnl"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    zf = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    j = stats.join(pnl, ["user_id", "hour"], "full_outer").select(
        "user_id", (F.col("hour") + 3600).alias("time_bucket"), F.lit("hourly").alias("period_type"), z("trades_count"),
        zf("total_volume"), zf("realized_pnl"), zf("unrealized_pnl"), zf("avg_trade_size"), zf("largest_trade"),
        F.coalesce("symbols_traded", F.array().cast("array<string>")).alias("symbols_traded"), z("winning_trades"),
        z("losing_trades"), zf("total_trades_profit"), zf("total_trades_loss")
    ).withColumn("total_pnl", F.col("realized_pnl") + F.col("unrealized_pnl")).withColumn(
        "unique_symbols_count", F.size("symbols_traded").cast("long")).withColumn("win_rate", ratio0("winning_trades", "trades_count") * 100)
    pnl_abs = F.abs("total_pnl")
    return j.withColumn("avg_profit_per_trade", ratio0("total_trades_profit", "winning_trades")) \
        .withColumn("avg_loss_per_trade", ratio0("total_trades_loss", "losing_trades")) \
        .withColumn("profit_factor", ratio0("total_trades_profit", "total_trades_loss")) \
        .withColumn("activity_score", F.col("trades_count") * 0.3 + F.least(F.col("total_volume") / 10000, F.lit(100.0)) * 0.3
                    + F.col("unique_symbols_count") * 10 * 0.2 + F.least(pnl_abs / 1000, F.lit(50.0)) * 0.2) \
        .withColumn("risk_score", F.when(
            F.col("trades_count") > 0,
            F.least(ratio("largest_trade", "avg_trade_size"), F.lit(10.0)) * 2 + (F.lit(100.0) - F.col("win_rate")) / 10
            + F.least(ratio(pnl_abs, "total_volume") * 100, F.lit(10.0))).otherwise(0.0))


def user_activity_daily(hourly: DataFrame) -> DataFrame:
    """Hourly rows rolled to the day they lie in, stamped with the day's end; symbol sets are united."""
    sums = ["trades_count", "total_volume", "winning_trades", "losing_trades", "total_trades_profit", "total_trades_loss"]
    means = ["realized_pnl", "unrealized_pnl", "total_pnl", "avg_trade_size", "win_rate", "avg_profit_per_trade",
             "avg_loss_per_trade", "profit_factor", "activity_score", "risk_score"]
    day = bucket("time_bucket", 86400) + 86400
    return hourly.groupBy("user_id", day.alias("time_bucket")).agg(
        F.lit("daily").alias("period_type"), *[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means],
        F.max("largest_trade").alias("largest_trade"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("symbols_traded")))).alias("symbols_traded"),
    ).withColumn("unique_symbols_count", F.size("symbols_traded").cast("long"))


def shown_score(score: str | Column) -> Column:
    """Six places; the shift is far above the noise of a sum and far below a place, so ties always go up."""
    return F.round((F.col(score) if isinstance(score, str) else score) + F.lit(1e-9), 6)


def _processed(rows: DataFrame, period_type: str, days: int, as_of: int) -> DataFrame:
    return rows.filter((F.col("period_type") == period_type) & (F.col("time_bucket") >= as_of - days * 86400)
                       & (F.col("time_bucket") <= as_of))


def user_activity_summary(rows: DataFrame, period_type: str, days: int, as_of: int, user: str | None = None) -> DataFrame:
    p = _processed(rows, period_type, days, as_of)
    p = p if user is None else p.filter(F.col("user_id") == user)
    return p.select("user_id", "time_bucket", "trades_count", "total_volume", "total_pnl", "win_rate", "activity_score", "risk_score")


def top_traders_by_activity(rows: DataFrame, period_type: str, days: int, as_of: int, limit: int = 100) -> DataFrame:
    return _processed(rows, period_type, days, as_of).groupBy("user_id").agg(
        F.sum("total_volume").alias("total_volume"), F.sum("total_pnl").alias("total_pnl"),
        shown_score(F.avg("activity_score")).alias("avg_activity_score"), F.avg("win_rate").alias("avg_win_rate"),
        F.sum("trades_count").alias("total_trades"), F.avg("unique_symbols_count").alias("avg_symbols")).orderBy(
        F.col("avg_activity_score").desc(), "user_id").limit(limit)


def user_activity_list(rows: DataFrame, period_type: str, days: int, as_of: int, limit: int = 100,
                       users: list[str] | None = None) -> DataFrame:
    p = _processed(rows, period_type, days, as_of)
    p = p.filter(F.col("user_id").isin(users)) if users else p
    return p.withColumn("activity_score", shown_score("activity_score")).orderBy(
        F.col("time_bucket").desc(), F.col("activity_score").desc(), "user_id").limit(limit)
