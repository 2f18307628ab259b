"""Ranked boards over hourly PnL and volume, their rollups and their health checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.columns import above, at_least, ratio, ratio0
from tickforge.functions.timeutil import bucket, in_period
from tickforge.operators.ranking import global_rank, top_ranked

# Trader classes by mean trade size, activity levels by active hours.
TRADER_TYPES = [(10_000, "whale"), (1_000, "large_trader"), (100, "regular_trader")]
ACTIVITY_LEVELS = [(16, "very_active"), (8, "active"), (4, "moderate")]
REQUIRED_TABLES = ("hourly_pnl_metrics", "daily_user_activity", "startup_data_jobs", "positions")


def _best(c: str) -> list[Column]:
    return [F.round(F.col(c), 6).desc(), F.col("user_id").asc()]


def pnl_leaderboard(hourly: DataFrame, period: str, as_of: int, limit: int = 100) -> DataFrame:
    """Best users by PnL over the period; only the kept rows are numbered."""
    per = hourly.filter(in_period("bucket", period, as_of)).groupBy("user_id").agg(
        F.sum("total_pnl").alias("total_pnl"), F.sum("total_realized_pnl").alias("realized_pnl"),
        F.sum("total_unrealized_pnl").alias("unrealized_pnl"))
    return top_ranked(per, _best("total_pnl"), limit)


def volume_leaderboard(activity: DataFrame, period: str, as_of: int, limit: int = 100) -> DataFrame:
    """Best users by volume with trader class and volume per trade. ``activity``: daily_user_activity."""
    per = activity.filter(in_period("bucket", period, as_of)).groupBy("user_id").agg(
        F.sum("total_volume").alias("total_volume"), F.sum("trades_count").alias("total_trades"))
    per = per.withColumn("volume_per_trade", ratio0("total_volume", "total_trades")).withColumn(
        "trader_type", above("volume_per_trade", TRADER_TYPES, "small_trader"))
    return top_ranked(per, _best("total_volume"), limit)


def pnl_lb_hourly(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy(bucket("bucket", 3600).alias("period_bucket"), "user_id").agg(
        F.sum("total_pnl").alias("total_pnl"), F.sum("total_realized_pnl").alias("realized_pnl"),
        F.sum("total_unrealized_pnl").alias("unrealized_pnl"), F.count(F.lit(1)).alias("trading_sessions"),
        F.avg("total_pnl").alias("avg_pnl_per_session"), F.max("total_pnl").alias("best_session_pnl"),
        F.min("total_pnl").alias("worst_session_pnl"))


def pnl_lb_daily(by_hour: DataFrame) -> DataFrame:
    return by_hour.groupBy(bucket("period_bucket", 86400).alias("daily_bucket"), "user_id").agg(
        F.sum("total_pnl").alias("daily_total_pnl"), F.sum("realized_pnl").alias("daily_realized_pnl"),
        F.sum("unrealized_pnl").alias("daily_unrealized_pnl"), F.count(F.lit(1)).alias("active_hours"),
        F.avg("total_pnl").alias("avg_hourly_pnl"), F.max("total_pnl").alias("best_hour_pnl"), F.min("total_pnl").alias("worst_hour_pnl"))


def volume_lb_hourly(trades: DataFrame) -> DataFrame:
    """User x hour volume from trades. The peaks compare the user's hours of that day at the next level."""
    return trades.groupBy(bucket("ts", 3600).alias("period_bucket"), "user_id").agg(
        F.sum("quote_qty").alias("total_volume"), F.count(F.lit(1)).alias("total_trades"),
        F.avg("quote_qty").alias("avg_trade_size"))


def volume_lb_daily(by_hour: DataFrame) -> DataFrame:
    return by_hour.groupBy(bucket("period_bucket", 86400).alias("daily_bucket"), "user_id").agg(
        F.sum("total_volume").alias("daily_total_volume"), F.sum("total_trades").alias("daily_total_trades"),
        F.avg("avg_trade_size").alias("daily_avg_trade_size"), F.count(F.lit(1)).alias("daily_active_hours"),
        F.max("total_volume").alias("daily_peak_volume"), F.max("total_trades").alias("daily_peak_trades"),
    ).withColumn("activity_level", at_least("daily_active_hours", ACTIVITY_LEVELS, "light"))


def pnl_lb_24h(by_hour: DataFrame, as_of: int) -> DataFrame:
    total = F.col("total_pnl")
    per = by_hour.filter(in_period("period_bucket", "24h", as_of)).groupBy("user_id").agg(
        F.round(F.sum("total_pnl"), 8).alias("total_pnl"), F.sum("realized_pnl").alias("realized_pnl"),
        F.sum("unrealized_pnl").alias("unrealized_pnl"), F.count(F.lit(1)).alias("trading_sessions"),
        F.avg("total_pnl").alias("avg_pnl_per_session"), F.abs(F.min("worst_session_pnl")).alias("worst"))
    per = per.filter(total.isNotNull()).withColumn("performance_status", F.when(total > 0, "profitable").when(total == 0, "breakeven").otherwise("loss")) \
        .withColumn("risk_level", F.when(F.col("worst") > total * 2, "high_risk").when(F.col("worst") > total, "medium_risk").otherwise("low_risk")).drop("worst")
    return global_rank(per, _best("total_pnl"))


def _pnl_days(by_day: DataFrame, period: str, as_of: int) -> DataFrame:
    return by_day.filter(in_period("daily_bucket", period, as_of)).groupBy("user_id").agg(
        F.sum("daily_total_pnl").alias("total_pnl"), F.sum("daily_realized_pnl").alias("realized_pnl"),
        F.sum("daily_unrealized_pnl").alias("unrealized_pnl"), F.count(F.lit(1)).alias("active_days"),
        F.avg("daily_total_pnl").alias("avg_daily_pnl"), F.stddev_samp("daily_total_pnl").alias("pnl_volatility"),
        F.max("daily_total_pnl").alias("best_day"), F.min("daily_total_pnl").alias("worst_day"),
        F.sum("active_hours").alias("total_active_hours"), F.avg("active_hours").alias("avg_hours_per_day")).filter(
        F.col("total_pnl").isNotNull())


def pnl_lb_7d(by_day: DataFrame, as_of: int) -> DataFrame:
    return global_rank(_pnl_days(by_day, "7d", as_of), _best("total_pnl"))


def pnl_lb_30d(by_day: DataFrame, as_of: int) -> DataFrame:
    per = _pnl_days(by_day, "30d", as_of).drop("total_active_hours", "avg_hours_per_day")
    per = per.withColumn("trading_frequency_pct", F.col("active_days") / 30.0 * 100).withColumn(
        "risk_adjusted_return", F.when(F.col("pnl_volatility") > 0, F.col("avg_daily_pnl") / F.col("pnl_volatility")).otherwise(0.0))
    return global_rank(per, _best("total_pnl"))


def volume_lb_24h(by_hour: DataFrame, as_of: int) -> DataFrame:
    per = by_hour.filter(in_period("period_bucket", "24h", as_of)).groupBy("user_id").agg(
        F.sum("total_volume").alias("total_volume"), F.sum("total_trades").alias("total_trades"),
        F.avg("avg_trade_size").alias("avg_trade_size"), F.count(F.lit(1)).alias("active_hours"),
        F.max("total_volume").alias("peak_volume"), F.max("total_trades").alias("peak_trades")).filter(F.col("total_volume") > 0)
    per = per.withColumn("volume_per_hour", ratio("total_volume", "active_hours")).withColumn(
        "trader_type", above("avg_trade_size", TRADER_TYPES, "small_trader"))
    return global_rank(per, _best("total_volume"))


def _volume_days(by_day: DataFrame, period: str, as_of: int) -> DataFrame:
    return by_day.filter(in_period("daily_bucket", period, as_of)).groupBy("user_id").agg(
        F.sum("daily_total_volume").alias("total_volume"), F.sum("daily_total_trades").alias("total_trades"),
        F.avg("daily_avg_trade_size").alias("avg_trade_size"), F.count(F.lit(1)).alias("active_days"),
        F.avg("daily_total_volume").alias("avg_daily_volume"), F.max("daily_peak_volume").alias("peak_volume"),
        F.sum("daily_active_hours").alias("total_active_hours"), F.avg("daily_active_hours").alias("avg_hours_per_day"),
        F.stddev_samp("daily_total_volume").alias("sd")).filter(F.col("total_volume") > 0)


def volume_lb_7d(by_day: DataFrame, as_of: int) -> DataFrame:
    per = _volume_days(by_day, "7d", as_of).drop("sd").withColumn("trader_type", above("avg_trade_size", TRADER_TYPES, "small_trader"))
    return global_rank(per, _best("total_volume"))


def volume_lb_30d(by_day: DataFrame, as_of: int) -> DataFrame:
    per = _volume_days(by_day, "30d", as_of).withColumn("trading_frequency_pct", F.col("active_days") / 30.0 * 100).withColumn(
        "volume_consistency", ratio("sd", "avg_daily_volume")).drop("sd", "avg_hours_per_day").withColumn(
        "trader_type", above("avg_trade_size", TRADER_TYPES, "small_trader"))
    return global_rank(per, _best("total_volume"))


def lb_performance_stats(pnl_board: DataFrame, volume_board: DataFrame, as_of: int) -> DataFrame:
    one = lambda df, c, name: df.agg(
        F.lit(name).alias("leaderboard_type"), F.count(F.lit(1)).alias("total_entries"), F.avg(c).alias("avg_value"),
        F.min(c).alias("min_value"), F.max(c).alias("max_value"), F.lit(as_of).cast("long").alias("last_updated"))
    return one(pnl_board, "total_pnl", "pnl_24h").unionByName(one(volume_board, "total_volume", "volume_24h"))


def _coverage(df: DataFrame, name: str, as_of: int) -> DataFrame:
    days = F.floor((F.lit(as_of) - F.min("bucket")) / 86400)
    return df.agg(F.count(F.lit(1)).alias("total_records"), F.count_distinct("user_id").alias("unique_users"),
                  F.min("bucket").alias("earliest_data"), F.max("bucket").alias("latest_data"),
                  F.coalesce(days, F.lit(0)).alias("days_covered")).withColumn("table_name", F.lit(name)).withColumn(
        "readiness", at_least("days_covered", [(30, "30d_ready"), (7, "7d_ready"), (1, "24h_ready")], "not_ready"))


def lb_data_coverage(hourly: DataFrame, activity: DataFrame, as_of: int) -> DataFrame:
    return _coverage(hourly, "hourly_pnl_metrics", as_of).unionByName(_coverage(activity, "daily_user_activity", as_of))


def lb_readiness(hourly: DataFrame, volume_30d: DataFrame, jobs: DataFrame, as_of: int,
                 present: list[str] = REQUIRED_TABLES) -> DataFrame:
    """PASS/FAIL checks as rows. ``jobs``: job_name, status, started_at."""
    cov = _coverage(hourly, "h", as_of).select(F.struct("days_covered", "unique_users").alias("c")).scalar()
    entries = volume_30d.agg(F.count(F.lit(1))).scalar()
    job = jobs.filter(F.col("job_name") == "initial_pnl_backfill").agg(F.max_by("status", "started_at")).scalar()
    missing = [t for t in REQUIRED_TABLES if t not in present]
    base = hourly.sparkSession.range(1).select(cov.alias("c"), entries.alias("n"), F.coalesce(job, F.lit("not_found")).alias("job"))
    row = lambda name, ok, details, bad, good: F.struct(
        F.lit(name).alias("check_name"), F.when(ok, "PASS").otherwise("FAIL").alias("status"), details.alias("details"),
        F.when(ok, good).otherwise(bad).alias("recommendation"))
    checks = F.array(
        row("pnl_coverage", F.col("c.days_covered") >= 30, F.format_string("%d days, %d users", F.col("c.days_covered"), F.col("c.unique_users")),
            "run the 35-day backfill", "covers all boards"),
        row("volume_30d_board", F.col("n") > 0, F.format_string("%d entries", F.col("n")), "check the source tables", "working"),
        row("startup_job", F.col("job") == "completed", F.col("job"), "wait for the startup job", "completed"),
        row("required_tables", F.lit(not missing), F.lit(", ".join(missing) or "all present"), "create the missing tables", "present"))
    return base.select(F.explode(checks).alias("x")).select("x.*")


def lb_health(hourly: DataFrame, pnl_30d: DataFrame, volume_30d: DataFrame, as_of: int) -> DataFrame:
    """One-row dashboard with an overall status."""
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    base = _coverage(hourly, "h", as_of).select("total_records", "unique_users", "days_covered").withColumn(
        "pnl_30d_users", n(pnl_30d)).withColumn("volume_30d_users", n(volume_30d))
    return base.withColumn("overall_health", F.when((F.col("volume_30d_users") > 0) & (F.col("days_covered") >= 30), "HEALTHY")
                           .when(F.col("total_records") == 0, "NO_DATA").when(F.col("days_covered") < 30, "INSUFFICIENT_DATA")
                           .otherwise("NEEDS_ATTENTION"))


def lb_page(board: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of a ranked board with its size."""
    total = board.agg(F.count(F.lit(1))).scalar()
    return board.filter((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).withColumn("total", total)


def lb_user_rank(snapshots: DataFrame) -> DataFrame:
    """Newest stored rank per user and board. ``snapshots``: board, user_id, rank, ts."""
    return snapshots.groupBy("board", "user_id").agg(F.max_by("rank", "ts").alias("rank"), F.max("ts").alias("as_of"))


def mv_volume_leaderboard(trades: DataFrame, as_of: int, n: int = 100) -> DataFrame:
    per = trades.filter(in_period("ts", "30d", as_of)).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_trades"), F.sum("quote_qty").alias("total_volume"), F.count_distinct("symbol").alias("symbols_traded"),
        F.max("ts").alias("last_trade_time"), F.min("ts").alias("first_trade_time"))
    return top_ranked(per, _best("total_volume"), n)


def mv_pnl_leaderboard(trades: DataFrame, as_of: int, n: int = 100) -> DataFrame:
    """Top traders by trade count; PnL belongs to the position tables and is not invented here."""
    per = trades.filter(in_period("ts", "30d", as_of)).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_trades"), F.sum("quote_qty").alias("total_volume"), F.max("ts").alias("last_trade_time"))
    return top_ranked(per, [F.col("total_trades").desc(), F.col("user_id").asc()], n)
