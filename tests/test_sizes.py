"""Steps whose tasks must not grow with the tables."""

from pyspark.sql import functions as F

from tickforge.operators.temporal import range_mean
from tickforge.plans import lending


def test_events_are_dealt_by_their_size(fx):
    plan = fx.base._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan and "REPARTITION_BY_NUM" not in plan


def test_borrowing_power_of_many_small_supplies(spark):
    """Ten times 0.1 is 1, in whatever order it is summed; amounts beyond exact sums are summed as they are."""
    supplies = spark.createDataFrame([("u", 0.1)] * 10 + [("v", 0.7), ("v", 0.2), ("v", 0.1), ("w", 1e30), ("w", 1.0)], "user_id string, supplied double")
    configs = spark.createDataFrame([(1, "t", 10000, 8000, True)], "chain_id int, token string, collateral_factor int, liquidation_threshold int, is_active boolean")
    got = {r.user_id: r.available for r in lending.lending_available_to_borrow(supplies, configs).filter(F.col("user_id") != "w").collect()}
    assert got == {"u": 1, "v": 1}
    assert lending.borrowing_base(supplies).filter("user_id = 'w'").head().collateral == 1e30


def test_mean_of_a_range(spark):
    """Dense seconds, gaps, repeated seconds, empty values; ranges of none, few and many seconds, without a sliding frame."""
    rows = [("a" if i % 5 else "b", i * i % 700 + 1000, None if i % 17 == 0 else float(i % 13)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, ts long, v double")
    for radius in (0, 1, 7, 100):
        out = range_mean(df, ["k"], "ts", "v", radius, "m")
        for k, ts, _, m in out.collect():
            near = [v for k2, t, v in rows if k2 == k and abs(t - ts) <= radius and v is not None]
            assert (m is None and not near) or abs(m - sum(near) / len(near)) < 1e-9, (radius, k, ts)
    assert "RangeFrame, -" not in out._jdf.queryExecution().optimizedPlan().toString()
