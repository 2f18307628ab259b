"""Streams fed in several files, with late and repeated rows, against the batch answer."""

import os

from pyspark.sql import functions as F

from tickforge.plans import books, ledger, trades
from tickforge.streaming import late, monitor, retries, stateful, streams


def feed(spark, df, path, files):
    """Write ``df`` as files that arrive in time order."""
    for i, f in enumerate(files):
        f.coalesce(1).write.mode("append").parquet(path)
        for name in os.listdir(path):
            if name.endswith(".parquet") and not name.startswith("f"):
                stamp = 1_700_000_000 + i * 60
                os.rename(f"{path}/{name}", f"{path}/f{i:03d}.parquet")
                os.utime(f"{path}/f{i:03d}.parquet", (stamp, stamp))
    return streams.stream_source(spark, path, df.schema, 1, "f*.parquet")


def cut(df, n):
    at = F.col("block_timestamp" if "block_timestamp" in df.columns else "ts")
    lo, hi = df.agg(F.min(at), F.max(at)).head()
    step = (hi - lo) // n + 1
    return [df.filter((at >= lo + i * step) & (at < lo + (i + 1) * step)) for i in range(n)]


def same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_candles_over_four_batches_with_repeats(spark, fx, tmp_path):
    t = fx.trades
    parts = cut(t, 4)
    parts[2] = parts[2].unionByName(parts[2].limit(20))
    src = feed(spark, t, str(tmp_path / "in"), parts)
    clean = streams.stream_dedup(src, ["trade_id"])
    out, q = streams.run(streams.stream_klines(clean, "1 hour"), "k", "update", path=str(tmp_path / "out"))
    assert len([p for p in q.recentProgress if p.numInputRows > 0]) == 4
    cols = ["chain_id", "symbol", "open_time", "open", "high", "low", "close", "trade_count"]
    got = streams.read_latest(spark, out, ["chain_id", "symbol", "open_time"]).select(cols)
    assert same(got, trades.klines(t, {"1h": 3600}).select(cols))


def test_late_rows_are_dropped_past_the_watermark(spark, fx, tmp_path):
    t = fx.trades
    parts = cut(t, 3)
    late = parts[0].orderBy("seq").limit(5).withColumn("price", F.lit(1e9)).withColumn("trade_id", F.col("trade_id") + 10**9)
    src = feed(spark, t, str(tmp_path / "in"), [parts[0], parts[1], parts[2], late.select(t.columns)])
    out, _ = streams.run(streams.stream_klines(src, "1 hour"), "k", "append", path=str(tmp_path / "out"))
    closed = spark.read.parquet(out)
    assert closed.count() > 0 and closed.filter("high >= 1e9").count() == 0
    batch = trades.klines(t, {"1h": 3600}).select("chain_id", "symbol", "open_time", "close", "trade_count")
    assert closed.select("chain_id", "symbol", "open_time", "close", "trade_count").exceptAll(batch).count() == 0


def totals(q):
    return [s.numRowsTotal for p in q.recentProgress for s in p.stateOperators]


def test_depth_over_batches(spark, fx, tmp_path):
    """The book after every event, compacted on the way, with a restart in between; state falls when orders close."""
    log = fx.event_log
    parts = cut(log, 4)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    sink = stateful.merged_sink(out, stateful.merge_levels, every=3)
    streams.run(stateful.stream_depth(feed(spark, log, path, parts[:2])), "d", each=sink, path=out)
    for i, part in enumerate(parts[2:]):
        part.coalesce(1).write.parquet(str(tmp_path / f"more{i}"))
        name = next(n for n in os.listdir(tmp_path / f"more{i}") if n.endswith(".parquet"))
        os.rename(tmp_path / f"more{i}" / name, f"{path}/f90{i}.parquet")
    again = streams.stream_source(spark, path, log.schema, 1, "f*.parquet")
    _, q = streams.run(stateful.stream_depth(again), "d", each=sink, path=out)
    cols = ["chain_id", "pool_id", "side", "price", "quantity", "order_count"]
    want = books.depth_incremental(log).filter("quantity > 0")
    assert same(stateful.read_depth(spark, out).select(cols), want.select(cols))
    top = stateful.read_depth(spark, out, 5)
    assert top.filter("level > 5").count() == 0 and top.count() <= 5 * 20
    assert stateful._parts(spark, out)[1] >= 2  # a base took the place of the first batches
    placed = log.filter("event_name = 'OrderPlaced'").count()
    live = want.agg(F.sum("order_count")).head()[0]
    assert totals(q)[-1] < placed and totals(q)[-1] <= live + log.filter("event_name <> 'OrderPlaced'").count()


def test_state_falls_when_orders_close(spark, tmp_path):
    rows = [("OrderPlaced", 1, "p", 1000 + i, i, 0, 100, 5, None, None, None) for i in range(50)]
    done = [("OrderCancelled", 1, "p", 90_000 + i, i, None, None, None, 3, None, None) for i in range(40)]
    lost = [("OrderMatched", 1, "p", 90_100, None, 0, 100, 1, None, 900, 901)]
    tick = [("OrderPlaced", 1, "p", 200_000, 999, 0, 100, 5, None, None, None)]
    log = spark.createDataFrame(rows + done + lost + tick, "event_name string, chain_id int, address string, block_timestamp long, order_id long, side_code int, price long, quantity long, status_code int, buy_order_id long, sell_order_id long")
    files = [log.filter("block_timestamp < 90000"), log.filter("block_timestamp between 90000 and 199999"), log.filter("block_timestamp >= 200000")]
    out = str(tmp_path / "out")
    _, q = streams.run(stateful.stream_depth(feed(spark, log, str(tmp_path / "in"), files)), "d", each=stateful.merged_sink(out, stateful.merge_levels), path=out)
    held = totals(q)
    assert max(held) >= 50 and held[-1] == 11  # ten open orders and the last one; the match of unknown orders is forgotten
    assert [(r.quantity, r.order_count) for r in stateful.read_depth(spark, out).collect()] == [(55, 11)]


def test_balances_over_batches(spark, fx, tmp_path):
    e = fx.ledger_events
    out = str(tmp_path / "out")
    src = feed(spark, e, str(tmp_path / "in"), cut(e, 3))
    streams.run(stateful.stream_balances(src), "b", each=stateful.merged_sink(out, stateful.merge_balances, every=2), path=out)
    want = ledger.balance_ledger(e).select("chain_id", "user_id", "currency", F.col("amount").alias("available"), "locked")
    assert same(stateful.read_merged(spark, out, stateful.merge_balances).select(want.columns), want)


def test_mini_ticker_of_every_minute(spark, tmp_path):
    """Every minute up to the watermark, trades at the borders of minutes and days, days without trades, two chains."""
    times = [0, 59, 60, 3540, 3599, 3600, 7199, 86399, 86400, 86460, 90000, 172799, 172800, 300000, 300700, 420000]
    rows = [(c, s, 86400 * 19000 + t, n, float(n * 7 % 11 + k + c), 1.0 + n) for k, (c, s) in enumerate([(1, "a"), (1, "b"), (2, "a")]) for n, t in enumerate(times) if n % (k + 1) == 0]
    t = spark.createDataFrame(rows, "chain_id int, symbol string, ts long, seq long, price double, quantity double")
    out, q = streams.run(stateful.stream_mini_ticker(feed(spark, t, str(tmp_path / "in"), cut(t, 3))), "m", path=str(tmp_path / "out"))
    got = spark.read.parquet(out).collect()
    end, want = (86400 * 19000 + 420000 - 600) // 60 * 60, {}
    for c, s, ts, n, price, quantity in rows:
        for k in range(1, 1441):
            at = ts - ts % 60 + 60 * k
            if at <= end:
                want.setdefault((c, s, at), []).append((n, price, quantity))
    assert {(r.chain_id, r.symbol, r.as_of): (r.close, r.high, r.low, r.volume, r.trade_count) for r in got} == {
        k: (max(v)[1], max(p for _, p, _ in v), min(p for _, p, _ in v), sum(q for *_, q in v), len(v)) for k, v in want.items()}
    assert len(got) == len(want)


def test_late_trades_are_kept_counted_and_repaired(spark, fx, tmp_path):
    """Trades an hour late end in the batch answer; only the candles they touch are written again."""
    t = fx.trades
    parts = cut(t.filter("chain_id = 1"), 3)
    late_ones = parts[0].orderBy("seq").limit(7)
    files = [parts[0].exceptAll(late_ones), parts[1], parts[2].unionByName(late_ones)]
    out = str(tmp_path / "out")
    streams.run(feed(spark, t, str(tmp_path / "in"), files), "k", each=late.candles_with_late_rows(out, 3600), path=out)
    cols = ["chain_id", "symbol", "open_time", "open", "high", "low", "close", "trade_count"]
    want = trades.klines(t.filter("chain_id = 1"), {"1h": 3600}).select(cols)
    assert not same(late.read_candles(spark, out, True).select(cols), want)
    touched = late_ones.select("symbol", F.col("ts") - F.col("ts") % 3600).distinct().count()
    assert late.repair_candles(spark, out, 3600) == {"late": 7, "rewritten": touched}
    assert same(late.read_candles(spark, out, True).select(cols), want)
    assert late.repair_candles(spark, out, 3600) == {"late": 0, "rewritten": 0}


def test_late_repeats_are_not_written_twice(spark, fx, tmp_path):
    t = fx.trades.filter("chain_id = 1")
    parts = cut(t, 3)
    lost, again = parts[0].orderBy("seq").limit(5), parts[0].orderBy(F.col("seq").desc()).limit(4)
    files = [parts[0].exceptAll(lost), parts[1].unionByName(parts[1].limit(30)), parts[2].unionByName(lost).unionByName(again)]
    out = str(tmp_path / "out")
    streams.run(feed(spark, t, str(tmp_path / "in"), files), "k", each=late.dedup_with_late_rows(out, ["trade_id"]), path=out)
    assert late.repair_dedup(spark, out, ["trade_id"]) == {"late": 9, "added": 5}
    assert same(late.read_deduped(spark, out).select("trade_id", "seq"), t.select("trade_id", "seq"))


def test_restart_continues_from_the_offsets(spark, fx, tmp_path):
    t = fx.trades
    parts = cut(t, 2)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    src = feed(spark, t, path, parts[:1])
    streams.run(streams.stream_trades(src), "s", path=out)
    first = spark.read.parquet(out).count()
    parts[1].coalesce(1).write.parquet(str(tmp_path / "more"))
    name = next(n for n in os.listdir(tmp_path / "more") if n.endswith(".parquet"))
    os.rename(tmp_path / "more" / name, f"{path}/f900.parquet")
    streams.run(streams.stream_trades(streams.stream_source(spark, path, t.schema, 1, "f*.parquet")), "s", path=out)
    assert first == parts[0].count() and spark.read.parquet(out).count() == t.count()


def test_quarantine_tries_again_and_gives_up(spark, tmp_path):
    fields = [{"symbol": "a", "price": "1.5", "quantity": "2", "timestamp": "7"}, {"symbol": "b", "price": "x", "quantity": "2", "timestamp": "7"},
              {"symbol": "c", "price": "1", "timestamp": "7"}]
    raw = spark.createDataFrame([("chain:1:trades", f) for f in fields], "topic string, fields map<string,string>")
    good, bad, needed = str(tmp_path / "good"), str(tmp_path / "bad"), ("price", "quantity", "timestamp")
    write = retries.quarantine("trades", needed, good, bad)
    write(raw, 0)
    write(raw, 0)  # a replayed batch changes nothing
    write(raw.limit(1), 1)  # nor does a message that comes twice
    assert [(r.symbol, r.price) for r in spark.read.parquet(good).collect()] == [("a", 1.5)]
    assert sorted(r.error for r in retries.quarantined(spark, bad).collect()) == ["missing or malformed price", "missing or malformed quantity"]
    assert retries.retry(spark, "trades", needed, good, bad, 59) == {"delivered": 0, "waiting": 0, "dead": 0}  # not due yet
    mended = F.when(F.col("fields")["symbol"] == "b", F.map_concat(F.map_filter("fields", lambda k, _: k != "price"), F.create_map(F.lit("price"), F.lit("9")))).otherwise(F.col("fields"))
    for _ in range(2):
        assert retries.retry(spark, "trades", needed, good, bad, 60, lambda due: due.withColumn("fields", mended)) == {"delivered": 1, "waiting": 1, "dead": 0}
    assert sorted((r.symbol, r.price, r.quantity) for r in spark.read.parquet(good).collect()) == [("a", 1.5, 2.0), ("b", 9.0, 2.0)]
    assert retries.retry(spark, "trades", needed, good, bad, 500) == {"delivered": 0, "waiting": 0, "dead": 1}
    assert retries.retry(spark, "trades", needed, good, bad, 5000) == {"delivered": 0, "waiting": 0, "dead": 0}
    last = {r.payload: (r.attempts, r.status) for r in retries.quarantined(spark, bad).collect()}
    assert last['{"symbol":"c","price":"1","timestamp":"7"}'] == (3, "dead")


def test_progress_beyond_a_hundred_batches(spark, tmp_path):
    n, path = 105, str(tmp_path / "in")
    for i in range(n):
        os.makedirs(path, exist_ok=True)
        with open(f"{path}/{i:03d}.txt", "w") as f:
            f.write("x\n" * 3)
    log = monitor.ProgressLog(spark, str(tmp_path / "log"))
    spark.streams.addListener(log)
    try:
        q = spark.readStream.option("maxFilesPerTrigger", 1).text(path).writeStream.queryName("many").format("noop").option(
            "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        log.wait_for(str(q.runId))
    finally:
        spark.streams.removeListener(log)
    lengths = spark.createDataFrame([("many", 3 * n + 5), ("never", 7)], "query string, length long")
    rows = {r["query"]: r for r in monitor.lag_report(monitor.read_progress(spark, log.path), lengths, 4_000_000_000).collect()}
    assert (rows["many"]["batches"], rows["many"]["read"], rows["many"]["pending"]) == (n, 3 * n, 5) and rows["many"]["idle_seconds"] > 0
    assert (rows["never"]["batches"], rows["never"]["pending"], rows["never"]["idle_seconds"]) == (0, 7, None) and len(q.recentProgress) <= 100
