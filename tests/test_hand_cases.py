"""Small inline inputs with answers worked out on paper."""

import pytest
from pyspark.sql import functions as F

from tickforge.functions.columns import currency_address, format_amount, format_bps, format_bytes, format_usd, mul_div_floor, row_key
from tickforge.operators.keyed import insert_ignore
from tickforge.operators.ranking import global_rank, group_median
from tickforge.operators.temporal import asof_join, islands, range_mean, running_sums
from tickforge.plans import books, bridge, flows, ledger, lending, limits, orders, positions, slippage, trades, users, volume, volume_etl
from tickforge.sources.event_log import factory_filter, static_pool_json

LOG = """event_name string, chain_id int, address string, block_number bigint, block_timestamp bigint, tx_hash string, log_index bigint,
 order_id bigint, user_id string, side_code int, price bigint, quantity bigint, is_market boolean, status_code int, filled bigint,
 buy_order_id bigint, sell_order_id bigint"""


def placed(i, t, oid, user, side, price, qty, status=0):
    return ("OrderPlaced", 1, "pool", t, t, f"tx{i}", i, oid, user, side, price, qty, False, status, None, None, None)


def matched(i, t, buy, sell, price, qty, taker_side=0):
    return ("OrderMatched", 1, "pool", t, t, f"tx{i}", i, None, "x", taker_side, price, qty, False, None, None, buy, sell)


def update(i, t, oid, code, filled=None, name="UpdateOrder"):
    return (name, 1, "pool", t, t, f"tx{i}", i, oid, None, None, None, None, False, code, filled, None, None)


def event_log(spark, rows):
    return spark.createDataFrame(rows, LOG).withColumn("seq", F.col("block_number") * 1000 + F.col("log_index"))


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_depth_counts_only_orders_that_left(spark):
    """Two asks of 10 and 5 at 100; 4 filled, then 6 filled, the other ask cancelled; a bid of 10 took both fills."""
    log = event_log(spark, [
        placed(1, 10, 1, "a", 1, 100, 10), placed(2, 11, 2, "b", 1, 100, 5), placed(3, 12, 3, "c", 0, 100, 4),
        matched(4, 12, 3, 1, 100, 4), placed(5, 13, 4, "c", 0, 99, 6)])
    assert rows(books.depth_incremental(log), "side", "price", "quantity", "order_count") == [
        ("Buy", 99, 6, 1), ("Buy", 100, 0, 0), ("Sell", 100, 11, 2)]
    more = log.unionByName(event_log(spark, [
        placed(6, 14, 5, "d", 0, 100, 6), matched(7, 14, 5, 1, 100, 6), update(8, 15, 2, 3, name="OrderCancelled")]))
    assert rows(books.depth_incremental(more), "side", "price", "quantity", "order_count") == [
        ("Buy", 99, 6, 1), ("Buy", 100, 0, 0), ("Sell", 100, 0, 0)]
    state = orders.order_current_state(more)
    assert dict(rows(state, "order_id", "status")) == {1: "FILLED", 2: "CANCELLED", 3: "FILLED", 4: "OPEN", 5: "FILLED"}
    assert dict(rows(state, "order_id", "filled"))[1] == 10
    rebuilt = books.depth_rebuild(state)
    assert rows(rebuilt, "side", "price", "quantity", "order_count") == [("Buy", 99, 6, 1)]


def test_chains_with_equal_pools_and_order_ids_stay_apart(spark):
    """One order 1 of the pool on each chain: the first is half filled, the second cancelled."""
    log = event_log(spark, [placed(1, 10, 1, "a", 1, 100, 10), placed(2, 11, 2, "c", 0, 100, 5), matched(3, 12, 2, 1, 100, 5)])
    other = event_log(spark, [placed(4, 5, 1, "b", 1, 100, 7), update(5, 6, 1, 3, name="OrderCancelled"), placed(6, 7, 9, "b", 1, 100, 2)])
    both = log.unionByName(other.withColumn("chain_id", F.lit(2)))
    assert rows(orders.order_current_state(both), "chain_id", "order_id", "user_id", "filled", "status") == [
        (1, 1, "a", 5, "PARTIALLY_FILLED"), (1, 2, "c", 5, "FILLED"), (2, 1, "b", 0, "CANCELLED"), (2, 9, "b", 0, "OPEN")]
    want = [(1, "Buy", 100, 0, 0), (1, "Sell", 100, 5, 1), (2, "Sell", 100, 2, 1)]
    assert rows(books.depth_incremental(both), "chain_id", "side", "price", "quantity", "order_count") == want
    assert rows(orders.order_status_updates(both), "chain_id", "order_id", "status") == [(2, 1, "CANCELLED")]
    assert orders.order_history_log(both).count() == 5


def test_book_replay_with_partial_fills_and_expiry(spark):
    """Order 1 (qty 10): open in hour 0, 4 then 7 filled in hours 1 and 2; order 2 (qty 3) expires in hour 2."""
    h = 3600
    o = spark.createDataFrame([(1, "p", 1, "Sell", 100, 10), (1, "p", 2, "Sell", 100, 3)],
                              "chain_id int, pool_id string, order_id bigint, side string, price bigint, quantity bigint")
    hist = spark.createDataFrame([
        (1, "p", 1, 10, 0, "OPEN", 1), (1, "p", 2, 20, 0, "OPEN", 2), (1, "p", 1, h + 5, 2, "PARTIALLY_FILLED", 3),
        (1, "p", 1, h + 9, 4, "PARTIALLY_FILLED", 4), (1, "p", 1, 2 * h + 1, 7, "PARTIALLY_FILLED", 5), (1, "p", 2, 2 * h + 2, 0, "EXPIRED", 6)],
        "chain_id int, pool_id string, order_id bigint, ts bigint, filled bigint, status string, seq bigint")
    got = books.book_history_hourly(o, hist, 0, 4 * h)
    assert rows(got, "hour", "quantity", "order_count") == [(0, 13, 2), (h, 9, 2), (2 * h, 3, 1), (3 * h, 3, 1)]
    stored = books.book_history_hourly(o, hist, 0, 2 * h)
    again = stored.unionByName(books.book_history_resume(o, hist, stored, 4 * h))
    assert rows(again, "hour", "quantity") == rows(got, "hour", "quantity")


TRADES = "chain_id int, user_id string, symbol string, side string, price double, quantity double, ts bigint, seq bigint"


def trade_rows(spark, steps, ts=None):
    data = [(1, "u", "s", side, float(p), float(q), (ts or (lambda i: i))(i), i) for i, (side, q, p) in enumerate(steps)]
    return spark.createDataFrame(data, TRADES).withColumn("is_buyer", F.col("side") == "Buy").withColumn(
        "quote_qty", F.col("price") * F.col("quantity"))


STEPS = [("Buy", 10, 100), ("Buy", 10, 120), ("Sell", 5, 130), ("Sell", 20, 90), ("Buy", 5, 80)]


def sequential(steps):
    q = c = r = 0.0
    for side, n, p in steps:
        if side == "Buy":
            q, c = q + n, c + n * p
        elif q > 0:
            avg, s = c / q, min(n, q)
            r += (p - avg) * s
            c -= avg * s
            q -= s
            if n > s:
                q, c = -(n - s), -((n - s) * p)
        else:
            q, c = q - n, c - n * p
    return q, c, r


def test_average_cost_after_first_sell(spark):
    p = positions.positions_fold(trade_rows(spark, STEPS[:3])).head()
    assert (p["quantity"], p["avg_cost"], p["realized_pnl"]) == pytest.approx((15, 110, 100))


def test_average_cost_through_a_short(spark):
    p = positions.positions_fold(trade_rows(spark, STEPS[:4])).head()
    assert (p["quantity"], p["avg_cost"], p["realized_pnl"]) == pytest.approx((-5, 90, -200))


def test_hourly_rule_resets_the_average_when_a_buy_ends_flat(spark):
    t = trade_rows(spark, STEPS)
    out = positions.pnl_backfill_hourly(t, 0, 3600).head()
    assert out["total_realized_pnl"] == pytest.approx(-200) and out["total_unrealized_pnl"] == 0
    assert (out["trades_count"], out["volume_traded"]) == (5, pytest.approx(1000 + 1200 + 650 + 1800 + 400))


def test_fold_over_many_chunks_equals_the_sequential_fold(spark):
    steps = [(("Buy", "Sell")[(i * 7) % 3 % 2], 1 + i % 5, 90 + (i * 37) % 23) for i in range(400)]
    t = trade_rows(spark, steps, ts=lambda i: i * 50)
    p = positions.positions_fold(t, rows=7).head()
    q, c, r = sequential(steps)
    assert (p["quantity"], p["realized_pnl"]) == pytest.approx((q, r))
    assert p["total_cost"] == pytest.approx(c)
    half = positions.positions_fold(t.filter("seq < 150"))
    assert positions.positions_incremental(t, half, {1: 149}).head()["realized_pnl"] == pytest.approx(r)


def test_chains_meet_by_time(spark):
    """One pool address on two chains whose block numbers differ: the chain with higher blocks is not the later one."""
    t = spark.createDataFrame([(1, "u", "s", "Buy", 10.0, 1.0, 100, 900, 1), (2, "u", "s", "Buy", 15.0, 1.0, 150, 3, 2), (2, "u", "s", "Sell", 20.0, 1.0, 200, 5, 3)],
                              TRADES + ", trade_id bigint").withColumn("is_buyer", F.col("side") == "Buy").withColumn("quote_qty", F.col("price") * F.col("quantity"))
    assert positions.latest_prices(t, ["symbol"]).head()["last_price"] == 20.0
    assert rows(positions.latest_prices(t), "chain_id", "last_price") == [(1, 10.0), (2, 20.0)]
    m = volume.trading_metrics(t, "1h").head()
    assert (m["open_price"], m["close_price"]) == (10.0, 20.0)
    assert {(r["open_price"], r["close_price"]) for r in volume_etl.volume_timeseries(t).collect()} == {(10.0, 20.0)}
    assert flows.capital_flow(t).filter("price_correlation <> 1.0 and net_flow > 0").count() == 0
    back = positions.pnl_backfill_hourly(t, 0, 3600).head()
    assert back["total_realized_pnl"] == 5.0  # bought at 15 and sold at 20 on chain 2; chain 1 keeps its own


def test_whales(spark):
    t = spark.createDataFrame([(999.99,), (1000.0,), (10000.0,), (100000.0,), (250000.0,)], "quote_qty double")
    assert [r["c"] for r in t.orderBy("quote_qty").select(slippage.size_class().alias("c")).collect()] == [
        "small", "medium", "large", "whale", "whale"]
    assert slippage.trade_size_filter(t, "medium").count() == 1


def test_open_and_close_follow_log_order_inside_a_second(spark):
    t = spark.createDataFrame([(1, "s", "Buy", 5.0, 1.0, 5.0, 60, 2), (1, "s", "Buy", 7.0, 1.0, 7.0, 60, 1)],
                              "chain_id int, symbol string, side string, price double, quantity double, quote_qty double, ts bigint, seq bigint")
    k = trades.klines(t, {"1m": 60}).head()
    assert (k["open"], k["close"], k["close_time"]) == (7.0, 5.0, 119)


def test_crossed_and_one_sided_books(spark):
    s = spark.createDataFrame([(0, 1, "a", "A", "Buy", 10.0, 1, 1, 10.0), (0, 1, "a", "A", "Sell", 9.0, 1, 1, 9.0), (0, 1, "b", "B", "Buy", 5.0, 1, 1, 5.0)],
                              "snapshot_ts bigint, chain_id int, pool_id string, symbol string, side string, price double, quantity bigint, order_count bigint, liquidity_value double")
    out = {r["pool_id"]: r for r in books.book_snapshot_aggregate(s).collect()}
    assert out["a"]["spread"] == 0.0125 and out["b"]["spread"] == 0.0125 and out["b"]["best_ask"] is None


def test_best_bids_are_the_highest(spark):
    d = spark.createDataFrame([(1, "p", s, p, 1, 1) for s in ("Buy", "Sell") for p in (1, 2, 3)],
                              "chain_id int, pool_id string, side string, price bigint, quantity bigint, order_count bigint")
    assert rows(books.depth_from_levels(d, 2), "side", "price") == [("Buy", 2), ("Buy", 3), ("Sell", 1), ("Sell", 2)]


def test_spine_fills_empty_buckets(spark):
    t = trade_rows(spark, [("Buy", 1, 10), ("Buy", 1, 10)], ts=lambda i: 1000000 + i * 7200)
    s = slippage.slippage_series(t, "24h", "hourly", 1000000 + 7200, 60)
    assert s.count() == 25 and s.agg(F.sum("trade_count")).head()[0] == 2
    assert s.filter("trade_count = 0 and avg_slippage <> 0").count() == 0


def test_products_beyond_38_digits(spark):
    df = spark.createDataFrame([("1" + "0" * 27, "1" + "0" * 12)], "q string, p string").select(
        F.col("q").cast("decimal(38,0)").alias("q"), F.col("p").cast("decimal(38,0)").alias("p"))
    assert str(df.select(mul_div_floor("q", "p", F.lit(18))).head()[0]) == "1" + "0" * 21
    odd = spark.createDataFrame([(7, 3)], "q bigint, p bigint").select(mul_div_floor("q", "p", F.lit(1)))
    assert int(odd.head()[0]) == 2


def test_addresses_compare_without_case(spark):
    log = event_log(spark, [placed(1, 1, 1, "a", 0, 1, 1)]).withColumn("address", F.lit("0xAbC"))
    pools = spark.createDataFrame([("0xaBc",), ("0xABC",)], "order_book string")
    assert factory_filter(log, pools).count() == 1


def test_rate_limiter(spark):
    """Three requests pass, the fourth in the window fails, one after the window fails on the cooldown, one after it passes."""
    t = [0, 10, 20, 30, 3700, 3 * 3600, 20 + 4 * 3600]
    req = spark.createDataFrame([("u", x, i) for i, x in enumerate(t)], "identifier string, ts bigint, seq bigint")
    got = {r["seq"]: r for r in limits.rate_limit(req).collect()}
    assert [got[i]["allowed"] for i in range(7)] == [True, True, True, False, False, False, True]
    assert [got[i]["reason"] for i in (3, 4, 5)] == ["RATE_LIMIT", "COOLDOWN", "COOLDOWN"]
    assert [got[i]["remaining"] for i in range(4)] == [2, 1, 0, 0]
    assert (got[3]["reset_ts"], got[4]["reset_ts"]) == (3600, 20 + 4 * 3600)


def test_rate_limiter_many_requests_in_one_second(spark):
    req = spark.range(1000).select(F.lit("U").alias("address"), F.lit("ip").alias("ip"), F.lit(5).cast("bigint").alias("ts"), F.col("id").alias("seq"))
    out = limits.both_limits(req)
    assert out.filter("allowed").count() == 3 and out.filter("reason = 'ADDRESS_RATE_LIMIT'").count() == 997


def test_bridge_halves(spark):
    m = spark.createDataFrame([(1, "DISPATCH", 1, "t1", 5), (1, "PROCESS", 2, "t2", 9), (2, "DISPATCH", 1, "t3", 6), (3, "PROCESS", 2, "t4", 7)],
                              "message_id bigint, type string, chain_id int, tx_hash string, ts bigint")
    assert rows(bridge.bridge_links(m), "message_id", "status") == [(1, "RELAYED"), (2, "SENT"), (3, "RELAYED")]


def test_ledger_legs(spark):
    e = spark.createDataFrame([
        ("deposit", 1, "a", "c", 100, 0, "", "", 1, 1, 1), ("lock", 1, "a", "c", 40, 0, "", "", 2, 2, 2), ("unlock", 1, "a", "c", 10, 0, "", "", 3, 3, 3),
        ("transfer", 1, "a", "c", 20, 2, "b", "o", 4, 4, 4), ("transfer_locked", 1, "a", "c", 30, 3, "b", "o", 5, 5, 5), ("withdraw", 1, "a", "c", 5, 0, "", "", 6, 6, 6)],
        "op string, chain_id int, user_id string, currency string, amount bigint, fee bigint, receiver string, operator string, ts bigint, block_number bigint, seq bigint")
    assert rows(ledger.balance_ledger(e), "user_id", "amount", "locked") == [("a", 45, 0), ("b", 45, 0), ("o", 5, 0)]
    last = ledger.balance_history(e, partitions=5).filter("user_id = 'a'").orderBy(F.col("seq").desc()).head()
    assert (last["available"], last["locked"]) == (45, 0)


def test_asof_sees_equal_instants_and_respects_tolerance(spark):
    left = spark.createDataFrame([("s", 100), ("s", 7300), ("s", 7299), ("x", 5)], "k string, ts bigint")
    ev = spark.createDataFrame([("s", 100, 1, 1.0), ("s", 100, 2, 2.0), ("s", 50, 0, 0.5)], "k string, ts bigint, seq bigint, v double")
    got = {(r["k"], r["ts"]): r["v"] for r in asof_join(left, ev, ["k"], "ts", ["v"], "seq", 7199).collect()}
    assert got == {("s", 100): 2.0, ("s", 7299): 2.0, ("s", 7300): None, ("x", 5): None}


def test_range_mean_crosses_chunk_borders(spark):
    df = spark.createDataFrame([("s", 3590, 1.0), ("s", 3610, 3.0), ("s", 3700, 100.0)], "k string, ts bigint, v double")
    got = {r["ts"]: r["m"] for r in range_mean(df, ["k"], "ts", "v", 60, "m").collect()}
    assert got == {3590: 2.0, 3610: 2.0, 3700: 100.0}


def test_running_sums_over_partitions(spark):
    df = spark.range(100).select(F.lit("k").alias("k"), F.col("id").alias("o"), F.lit(1).cast("long").alias("x"))
    assert rows(running_sums(df, ["k"], "o", ["x"], partitions=7), "o", "x_after") == [(i, i + 1) for i in range(100)]
    assert rows(running_sums(df, ["k"], "o", ["x"], "_before", True, 3), "o", "x_before") == [(i, i) for i in range(100)]


def test_refused_by_ip_uses_no_address_quota(spark):
    """Three of b use up the shared IP; a's request there is refused and leaves a all three of its own elsewhere."""
    asked = [("b", "x", 0), ("b", "x", 1), ("B", "x", 2), ("a", "x", 3), ("a", "y", 4), ("a", "y", 5), ("a", "z", 6), ("a", "y", 7), ("c", "x", 3700), ("c", "x", 2 + 4 * 3600)]
    req = spark.createDataFrame([(a, ip, t, i) for i, (a, ip, t) in enumerate(asked)], "address string, ip string, ts bigint, seq bigint")
    for n in (1, 1_000_000):
        got = {r["seq"]: (r["allowed"], r["reason"], r["remaining"], r["reset_ts"]) for r in limits.both_limits(req, rows=n).collect()}
        assert got == {0: (True, None, 2, 3600), 1: (True, None, 1, 3600), 2: (True, None, 0, 3600), 3: (False, "IP_RATE_LIMIT", 0, 3600),
                       4: (True, None, 2, 3604), 5: (True, None, 1, 3604), 6: (True, None, 0, 3604), 7: (False, "ADDRESS_RATE_LIMIT", 0, 3604),
                       8: (False, "IP_COOLDOWN", 0, 2 + 4 * 3600), 9: (True, None, 2, 2 + 5 * 3600)}


def test_split_windows_equal_the_streamed_ones(spark):
    """A hot identifier over many chunks, one with bursts and one with gaps: pointers against the plain fold."""
    ids = [("hot", t) for t in range(0, 400_000, 97)] + [("burst", t // 5) for t in range(3000)] + [("gap", t * t) for t in range(600)]
    req = spark.createDataFrame([(a, t, i) for i, (a, t) in enumerate(ids)], "identifier string, ts bigint, seq bigint")
    split, plain = limits.rate_limit(req, rows=1), limits.rate_limit(req)
    assert split.exceptAll(plain).count() == 0 and plain.exceptAll(split).count() == 0 and plain.count() == len(ids)


def test_islands_across_days(spark):
    pts = spark.createDataFrame([(i * 40000, 1 if 3 <= i <= 5 else 0, 2) for i in range(10)], "ts bigint, f int, w bigint")
    assert rows(islands(pts, "ts", "f", "w"), "start", "end", "f", "weight") == [
        (0, 80000, 0, 6), (120000, 200000, 1, 6), (240000, 360000, 0, 8)]


def test_exact_median_even_and_hot(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 10.0), ("a", 4.0)] + [("b", 0.0)] * 999 + [("b", 5.0)], "k string, v double")
    assert rows(group_median(df, ["k"], "v"), "k", "median") == [("a", 3.0), ("b", 0.0)]


def test_global_rank_has_no_holes(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("u"), (F.col("id") % 7).cast("double").alias("v"))
    ranked = global_rank(df, [F.col("v").desc(), F.col("u").asc()])
    assert [r["rank"] for r in ranked.select("rank").orderBy("rank").collect()] == list(range(1, 5001))
    assert ranked.filter("rank = 1").head()["v"] == 6.0


def test_insert_ignore_keeps_the_first_write(spark):
    t = spark.createDataFrame([("a", 1, 0)], "k string, v int, o int")
    b = spark.createDataFrame([("a", 9, 1), ("b", 5, 3), ("b", 4, 2)], "k string, v int, o int")
    assert rows(insert_ignore(t, b, ["k"], "o"), "k", "v") == [("a", 1), ("b", 4)]


def test_lending_bands(spark):
    c = spark.createDataFrame([("a", 8000, 100), ("b", 7500, 0), ("c", 7000, 0), ("d", 6999, 50)], "token string, collateral_factor int, reserve_factor int").select(
        F.lit(1).alias("chain_id"), "token", "collateral_factor", "reserve_factor", F.lit(0).cast("long").alias("ts"))
    assert rows(lending.pool_lending_rates(c), "token", "supply_rate", "borrow_rate") == [
        ("a", 150, 410.0), ("b", 250, 600.0), ("c", 350, 800.0), ("d", 500, 1205.0)]


def test_period_stats_ignore_other_symbols(spark):
    t = trade_rows(spark, [("Buy", 2, 10)], ts=lambda i: 1000)
    assert volume.trades_summary(t, "1h", 1000, "s").head()["total_volume"] == 20.0
    assert volume.trades_summary(t, "1h", 1000, "other").head()["total_volume"] == 0.0


def test_text_formats(spark):
    one = spark.range(1)
    got = one.select(format_amount(F.lit(0.0012346)), format_amount(F.lit(1234.5)), format_amount(F.lit(1.23456)), format_usd(F.lit(1234.5)),
                     format_bps(F.lit(150)), format_bytes(F.lit(1536)), currency_address(F.lit("0xAB")), row_key(F.lit(1), F.lit(None))).head()
    assert list(got)[:7] == ["0.001235", "1,234.50", "1.23456", "$1,234.50", "1.5%", "1.50 KB", "0x" + "0" * 38 + "ab"]
    import hashlib

    assert got[7] == hashlib.sha256(b"1_null").hexdigest()


def test_pool_document(spark, tmp_path):
    doc = """{"data": {"poolss": {"items": [
      {"id": "1", "chainId": 5, "coin": "A/B", "orderBook": "0xX", "baseDecimals": 18, "quoteDecimals": 6, "price": "1", "volume": "2",
       "volumeInQuote": "3", "timestamp": 7, "baseCurrency": {"address": "0xAA", "symbol": "A"}, "quoteCurrency": {"address": "0xBB", "symbol": "B"}}]}}}"""
    (tmp_path / "pools.json").write_text(doc)
    got = static_pool_json(spark, str(tmp_path)).head()
    assert (got["coin"], got["base_address"], got["quote_symbol"], got["base_decimals"]) == ("A/B", "0xaa", "B", 18)


def test_a_series_without_limit_starts_with_the_first_row(spark):
    t = trade_rows(spark, [("Buy", 1, 10), ("Sell", 1, 10)], ts=lambda i: 1_700_000_000 + i * 7200)
    as_of = 1_700_000_000 + 4 * 3600
    for series in (users.cumulative_new_traders, users.unique_traders_series):
        out = series(t, "all", "1h", as_of)
        assert out.count() == 5 and out.agg(F.min("timestamp")).head()[0] == 1_700_000_000 // 3600 * 3600
    assert slippage.slippage_series(t, "all", "1h", as_of).count() == 5
    assert volume.symbol_volume_series(t, "all", "1h", as_of).count() == 2
