"""Capital flow: what does not depend on the trader is not kept per trader."""

from pyspark.sql import functions as F

from tickforge.plans import flows


def test_trader_rows_carry_trader_columns_only(fx):
    plan = flows.capital_flow(fx.trades)._jdf.queryExecution().optimizedPlan().toString()
    per_trader = [line for line in plan.splitlines() if "Aggregate [" in line and "user_id" in line.split("],")[0]]
    assert per_trader and not any("min_by" in line or "whale" in line for line in per_trader)


def test_missing_symbols_are_a_group(spark):
    rows = [(None, "a", True, 5.0, 2.0, 10, 1), (None, "b", False, 6.0, 3.0, 20, 2), ("s", "a", True, 5.0, 1.0, 30, 3)]
    trades = spark.createDataFrame(rows, "symbol string, user_id string, is_buyer boolean, price double, quantity double, ts long, seq long").withColumn(
        "quote_qty", F.col("price") * F.col("quantity")).withColumn("side", F.when(F.col("is_buyer"), "Buy").otherwise("Sell")).withColumn("chain_id", F.lit(1))
    got = {r.symbol: r for r in flows.capital_flow(trades, {"1h": 3600}, 15, 0).collect()}
    assert set(got) == {None, "s"}
    r = got[None]
    assert (r.net_flow, r.unique_inflow_addresses, r.unique_outflow_addresses, r.institutional_flow) == (-8.0, 1, 1, -18.0)
    assert got["s"].institutional_flow == 0.0
