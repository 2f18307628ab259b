"""Properties that hold on any input."""

from pyspark.sql import functions as F

from tickforge.fixtures import AS_OF
from tickforge.plans import books, leaderboards, ledger, trades, users, volume


def test_candles_are_ordered_and_nest(fx):
    k = trades.klines(fx.trades)
    assert k.filter("low > open or low > close or high < open or high < close").count() == 0
    hours = k.filter("interval = '1h'").select("chain_id", "symbol", "open_time", "open", "high", "low", "close", F.round("volume", 2).alias("volume"), "trade_count")
    minutes = k.filter("interval = '1m'").withColumn("h", F.col("open_time") - F.col("open_time") % 3600)
    again = minutes.groupBy("chain_id", "symbol", F.col("h").alias("open_time")).agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "open_time").alias("close"), F.round(F.sum("volume"), 2).alias("volume"), F.sum("trade_count").alias("trade_count"))
    assert hours.exceptAll(again).count() == 0 and again.exceptAll(hours).count() == 0


def test_ledger_history_ends_at_the_balance(fx):
    hist = ledger.balance_history(fx.ledger_events)
    last = hist.groupBy("user_id", "currency").agg(
        F.max_by("available", F.struct("seq", "leg")).alias("amount"), F.max_by("locked", F.struct("seq", "leg")).alias("locked"))
    bal = ledger.balance_ledger(fx.ledger_events).select("user_id", "currency", "amount", "locked")
    assert bal.exceptAll(last).count() == 0
    moved = ledger.ledger_deltas(fx.ledger_events).filter(F.col("leg") >= 0)
    per_transfer = moved.join(fx.ledger_events.filter("op like 'transfer%'").select("seq"), "seq").groupBy("seq").agg(
        F.sum(F.col("d_amount") + F.col("d_locked")).alias("s"))
    assert per_transfer.filter("s <> 0").count() == 0


def test_incremental_depth_equals_rebuilt_depth(fx):
    inc = books.depth_incremental(fx.event_log).filter("quantity > 0").select("chain_id", "pool_id", "side", "price", "quantity", "order_count")
    full = fx.depth.filter("quantity > 0").select("chain_id", "pool_id", "side", "price", "quantity", "order_count")
    assert inc.exceptAll(full).count() == 0 and full.exceptAll(inc).count() == 0
    assert inc.filter("quantity < 0 or order_count < 0").count() == 0


def test_buy_and_sell_make_the_total(fx):
    m = volume.bucket_metrics(fx.trades, symbol=F.col("symbol"))
    assert m.filter("abs(buy_volume + sell_volume - volume) > 0.001").count() == 0


def test_new_and_returning_make_unique(fx):
    s = users.unique_traders_series(fx.trades, "30d", "daily", AS_OF)
    assert s.filter("new_traders + returning_traders <> unique_traders").count() == 0
    assert s.agg(F.sum("new_traders")).head()[0] == fx.users.filter(F.col("first_seen") >= AS_OF - 720 * 3600).count()


def test_ranks_run_from_one_without_holes(fx):
    board = leaderboards.volume_lb_30d(leaderboards.volume_lb_daily(leaderboards.volume_lb_hourly(fx.trades)), AS_OF)
    got = [r["rank"] for r in board.select("rank").orderBy("rank").collect()]
    assert got == list(range(1, len(got) + 1)) and got


def test_every_fill_side_has_one_owner(fx):
    assert fx.trades_enriched.count() == 2 * fx.fills.count()


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    import pytest

    from tickforge.session import checkpoint_dir

    context = SimpleNamespace(getConf=lambda: SimpleNamespace(get=lambda k: None), getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: None), sparkContext=context))


def test_a_day_is_several_files_and_an_emptied_day_goes(spark, fx, tmp_path):
    import os

    from pyspark.sql import functions as F

    from tickforge.sources import tables

    path, count = str(tmp_path / "t"), lambda t: t.groupBy((F.col("ts") - F.col("ts") % 60).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join files this small
    try:
        tables.replace_bucket(count(fx.trades), path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    days = sorted(d for d in os.listdir(path) if d.startswith("date="))
    assert max(len([f for f in os.listdir(f"{path}/{d}") if f.endswith(".parquet")]) for d in days) > 1
    day = 1704067200 + 5 * 86400
    source = fx.trades.filter(~F.col("ts").between(day, day + 86399))
    tables.incremental_bucket_refresh(source, path, count, day + 2 * 86400, "1m", 3 * 86400)
    left = sorted(d for d in os.listdir(path) if d.startswith("date="))
    assert set(days) - set(left) == {"date=2024-01-06"} and tables.read_table(spark, str(tmp_path / "none")) is None


def test_book_histories_over_the_whole_span(spark, sf, fx):
    from tickforge.registry import load

    run = load().spark_queries()
    whole = run["book_history_hourly"](spark, sf)
    first = fx.order_history.agg(F.min("ts")).head()[0]
    start = AS_OF - 3 * 86400
    days = books.book_history_hourly(fx.orders, fx.order_history, start, AS_OF)
    assert whole.agg(F.min("hour")).head()[0] < first + 86400 < start
    assert whole.filter(F.col("hour") >= start).select(days.columns).exceptAll(days).count() == 0 and whole.filter(F.col("hour") >= start).count() == days.count()
    assert run["liquidity_metrics"](spark, sf).filter(F.col("snapshot_ts") <= start).count() > 0


def test_an_emptied_newest_day_goes(spark, fx, tmp_path):
    from tickforge.sources import tables

    path, count = str(tmp_path / "t"), lambda t: t.groupBy((F.col("ts") - F.col("ts") % 60).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    tables.incremental_since_max(fx.trades, path, count)
    last = fx.trades.agg(F.max("ts")).head()[0]
    tables.incremental_since_max(fx.trades.filter(F.col("ts") < last - last % 86400), path, count)
    assert tables.read_table(spark, path).agg(F.max("bucket")).head()[0] < last - last % 86400


def test_listings_above_the_broadcast_bound_are_the_same(spark):
    from tickforge.plans import lending

    users = spark.range(40).select(F.col("id").cast("string").alias("user_id"), F.lit(100.0).alias("supplied"))
    assets = spark.range(2500).select(F.lit(1).alias("chain_id"), F.concat(F.lit("t"), "id").alias("token"), F.lit(8000).alias("collateral_factor"),
                                      F.lit(9000).alias("liquidation_threshold"), (F.col("id") % 5 > 0).alias("is_active"))
    few, many = (lending.lending_available_to_borrow(users, assets, most) for most in (50_000, 10))
    assert few.count() == 40 * 2000 and few.exceptAll(many).count() == 0 and many.exceptAll(few).count() == 0
