"""Aggregates over spans and books given as spans against the expanded levels."""

from pyspark.sql import functions as F

from tickforge.fixtures import AS_OF
from tickforge.operators.temporal import over_spans
from tickforge.plans import books, liquidity


def test_aggregates_over_spans(spark):
    """Every first hour up to 20 with every length up to 20, and one long span."""
    rows = [("a" if (i + n) % 3 else "b", i * 3600, (i + n) * 3600, i * 31 + n) for i in range(20) for n in range(20)]
    rows += [("c", 5 * 3600, 900 * 3600, 7)]
    df = spark.createDataFrame(rows, "k string, a long, z long, v long")
    got = over_spans(df, ["k"], "a", "z", "hour", [F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"), F.max("v").alias("m")],
                     [F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("m").alias("m")])
    want = {}
    for k, a, z, v in rows:
        for hour in range(a, z + 1, 3600):
            want.setdefault((k, hour), []).append(v)
    assert {(r.k, r.hour): (r.s, r.n, r.m) for r in got.collect()} == {k: (sum(v), len(v), max(v)) for k, v in want.items()}


def test_liquidity_of_spans_is_that_of_levels(fx):
    start = AS_OF - 24 * 3600
    spans = books.book_spans(fx.orders, fx.order_history, start, AS_OF)
    levels = books.book_history_hourly(fx.orders, fx.order_history, start, AS_OF)
    near = lambda df: sorted(tuple(round(v, 3) if isinstance(v, float) else v for v in r) for r in df.collect())
    stamped = levels.withColumn("snapshot_ts", F.col("hour") + 3600)
    assert near(liquidity.liquidity_metrics_of_spans(spans, fx.pools, fx.trades, 3600, 7200)) == near(
        liquidity.liquidity_metrics(stamped, fx.pools, fx.trades, 3600, 7200))
    assert near(liquidity.value_history_aggregate(spans, fx.pools)) == near(
        books.book_snapshot_aggregate(liquidity.value_history(levels, fx.pools)))


def test_metric_queries_do_not_expand_levels(spark, fx, sf):
    """The plan behind the metrics has no row per level and hour for a join to broadcast."""
    from tickforge.registry import load

    plan = load().spark_queries()["liquidity_latest"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(from" not in plan and "_k" in plan
