"""Plan shape and skew: no nested-loop joins, pushed filters, hot keys spread over tasks."""

import contextlib
import io
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from tickforge.fixtures import AS_OF
from tickforge.operators.affine import ROWS
from tickforge.operators.temporal import asof_lookup
from tickforge.plans import flows, positions, trades, volume, volume_etl


def plan(df, mode="formatted"):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def test_entry_points_import_without_a_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q) and len(q) > 200"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/", 2)[0], timeout=120)


def test_entry_runs(spark):
    df = entry_points.entry(spark)
    assert df.columns[:4] == ["chain_id", "symbol", "interval", "open_time"] and df.count() > 0


@pytest.mark.parametrize("key", [
    "klines", "order_current_state", "depth_rebuild", "balance_ledger", "ticker_24h_from_buckets", "orders_by_user", "markets",
    "symbol_stats", "symbol_volume_series", "unique_traders_series", "symbol_unique_traders_series", "user_activity_hourly",
    "mid_price_asof", "mid_price_window", "capital_flow", "liquidity_now", "book_history_hourly", "positions_fold", "mark_price_asof",
    "pnl_backfill_hourly", "missed_trades_in_gaps", "lending_available_to_borrow", "inflow_series", "rate_limit"])
def test_no_nested_loop_joins(key, spark, sf):
    text = plan(entry_points.queries()[key](spark, sf), "simple")
    assert "NestedLoopJoin" not in text and "CartesianProduct" not in text


def test_filters_and_columns_reach_the_scan(spark, tmp_path, fx):
    fx.trades.write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    text = plan(volume.trades_summary(t, "24h", AS_OF))
    assert f"GreaterThanOrEqual(ts,{AS_OF - 86400})" in text and f"LessThanOrEqual(ts,{AS_OF})" in text
    schema = next(line for line in text.splitlines() if "ReadSchema" in line)
    assert "price" not in schema and "symbol" not in schema


def test_candles_aggregate_by_hash(spark, fx):
    text = plan(trades.klines(fx.trades), "simple")
    assert "HashAggregate" in text and "SortAggregate" not in text and "ObjectHashAggregate" not in text


def hot(spark, n=60_000):
    """A third of all rows belong to one user, one symbol and one hour pattern."""
    i = F.col("id")
    first = i % 3 == 0
    return spark.range(n).select(
        F.when(first, "hot").otherwise(F.concat(F.lit("u"), (i % 500).cast("string"))).alias("user_id"),
        F.when(first, "HOT").otherwise(F.concat(F.lit("s"), (i % 50).cast("string"))).alias("symbol"),
        F.when(i % 5 < 3, "Buy").otherwise("Sell").alias("side"), (i % 5 < 3).alias("is_buyer"),
        (100 + i % 7).cast("double").alias("price"), (1 + i % 3).cast("double").alias("quantity"),
        (i * 3).cast("long").alias("ts"), i.alias("seq")).withColumn("quote_qty", F.col("price") * F.col("quantity"))


def test_hot_position_is_folded_in_small_groups(spark):
    """100,000 trades of one user in one minute: no array and no window partition above its bound."""
    n, i = 100_000, F.col("id")
    t = spark.range(n).select(
        F.lit(1).alias("chain_id"), F.lit("hot").alias("user_id"), F.lit("HOT").alias("symbol"), F.when(i % 5 < 3, "Buy").otherwise("Sell").alias("side"),
        (100 + i % 7).cast("double").alias("price"), (1 + i % 3).cast("double").alias("quantity"), F.lit(60).cast("long").alias("ts"), i.alias("seq"))
    p = positions.positions_fold(t).head()
    q = c = r = 0.0
    for k in range(n):
        price, size = 100.0 + k % 7, 1.0 + k % 3
        if k % 5 < 3:
            q, c = q + size, c + size * price
        elif q > 0:
            some, avg = min(size, q), c / q
            r, c, q = r + (price - avg) * some, c - avg * some, q - some
            if size > some:
                q, c = some - size, (some - size) * price
        else:
            q, c = q - size, c - size * price
    assert (p["quantity"], p["total_cost"], p["realized_pnl"]) == pytest.approx((q, c, r))
    parts = t.repartitionByRange(8, "chain_id", "user_id", "symbol", "seq").groupBy(F.spark_partition_id()).count()
    assert parts.agg(F.max("count")).head()[0] < n / 4  # the window of a partition, not of the key
    numbers = t.groupBy(F.expr(f"seq div {ROWS}")).count().agg(F.max("count")).head()[0]
    assert numbers <= ROWS


def test_trades_are_not_exploded(spark, fx):
    for df in (volume_etl.volume_timeseries(fx.trades), flows.capital_flow(fx.trades)):
        tree = df._jdf.queryExecution().optimizedPlan().toString()
        for part in tree.split("Generate explode")[1:]:
            assert part.find("Aggregate") >= 0 or "LogicalRDD" in part  # what is copied per interval is a partial aggregate


def test_hot_symbol_asof_is_exact(spark):
    t = hot(spark, 6000)
    ev = t.filter("side = 'Sell'")
    got = asof_lookup(t, ev, ["symbol"], "ts", ["price"], "seq")
    brute = t.alias("a").join(ev.alias("b"), (F.col("a.symbol") == F.col("b.symbol")) & (F.col("b.ts") <= F.col("a.ts")), "left").groupBy(
        F.col("a.symbol").alias("symbol"), F.col("a.ts").alias("ts")).agg(F.max_by("b.price", "b.seq").alias("price"))
    a = got.select("symbol", "ts", "price")
    assert a.exceptAll(brute).count() == 0 and brute.exceptAll(a).count() == 0
