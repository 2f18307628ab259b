"""Streaming queries, drained once over the test files and compared with the batch answer."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.fixtures import AS_OF, Fixtures
from tickforge.functions.columns import r
from tickforge.registry.core import query, r2, r4, rounded, view
from tickforge.session import scratch_path
from tickforge.streaming import late, monitor, retries, stateful, streams


class StreamFixtures(Fixtures):
    """The same projections over a streaming read of the data files."""

    def table(self, name: str) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet").schema
        return streams.stream_source(self.spark, self.sf_dir, schema, 1, f"{name}.parquet")


def live(fx) -> StreamFixtures:
    return StreamFixtures(fx.spark, fx.sf_dir)


def drained(fx, df, name):
    """Append-mode drain and read back."""
    path, _ = streams.run(df, name)
    return fx.spark.read.parquet(path)


query("stream_source", "SELECT count(*) AS records, min(trade_id) AS first_id, max(trade_id) AS last_id FROM fx_trades")(
    lambda fx: drained(fx, live(fx).trades, "source").agg(
        F.count(F.lit(1)).alias("records"), F.min("trade_id").alias("first_id"), F.max("trade_id").alias("last_id")))

view("fx_raw", """SELECT 'chain:1:' || CASE WHEN e % 7 = 0 THEN 'balances' ELSE 'trades' END AS topic, pool AS symbol, CASE WHEN e % 11 = 0 THEN 'n/a' ELSE cast(value AS varchar) END AS price,
  cast(q AS varchar) AS quantity, cast(t AS varchar) AS timestamp, cast(u AS varchar) AS user_id, CASE WHEN e % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, cast(e AS varchar) AS trade_id FROM fx_base""")


def _raw(fx):
    """Messages as they travel: a topic and a map of text fields; some prices are garbage."""
    e = F.col("e")
    text = lambda c: F.col(c).cast("string")
    fields = F.create_map(
        F.lit("symbol"), F.col("pool"), F.lit("price"), F.when(e % 11 == 0, "n/a").otherwise(text("value")), F.lit("quantity"), text("q"),
        F.lit("timestamp"), text("t"), F.lit("userId"), text("u"), F.lit("side"), F.when(e % 2 == 0, "buy").otherwise("sell"), F.lit("tradeId"), text("e"))
    kind = F.when(e % 7 == 0, "balances").otherwise("trades")
    return live(fx).base.select(streams.topic_key(1, kind).alias("topic"), fields.alias("fields"), e.alias("seq"))


query("stream_parse_route", """SELECT topic, symbol, try_cast(price AS double) AS price, cast(quantity AS double) AS quantity, cast(timestamp AS bigint) AS timestamp, user_id AS "userId", side,
  trade_id AS "tradeId" FROM fx_raw WHERE topic = 'chain:1:trades'""")(
    lambda fx: drained(fx, streams.stream_parse_route(_raw(fx), "trades"), "routed").select(
        "topic", "symbol", "price", "quantity", "timestamp", "userId", "side", "tradeId"))


_SENT = "trade_id AS \"tradeId\", symbol, user_id AS \"userId\", side, quantity, timestamp"


@query("stream_quarantine", f"""SELECT 'bad' AS outcome, 'missing or malformed price' AS error, 2 AS attempts, price, {_SENT} FROM fx_raw WHERE topic = 'chain:1:trades' AND price = 'n/a' AND cast(trade_id AS bigint) % 2 = 0
  UNION ALL SELECT 'good', NULL, NULL, '1.0', {_SENT} FROM fx_raw WHERE topic = 'chain:1:trades' AND price = 'n/a' AND cast(trade_id AS bigint) % 2 = 1
  UNION ALL SELECT 'good', NULL, NULL, 'as sent', {_SENT} FROM fx_raw WHERE topic = 'chain:1:trades' AND price <> 'n/a'""")
def stream_quarantine(fx):
    """Messages without a price wait; when they are tried again, every other one has got one."""
    good, bad = scratch_path(fx.spark, "good"), scratch_path(fx.spark, "bad")
    mine = _raw(fx).filter(F.element_at(F.split("topic", ":"), -1) == "trades").withColumn("message_id", F.col("seq").cast("string"))
    required = ("price", "quantity", "timestamp")
    streams.run(mine, "quarantine", each=retries.quarantine("trades", required, good, bad))
    odd = F.col("message_id").cast("bigint") % 2 == 1
    priced = F.map_concat(F.map_filter("fields", lambda k, _: k != "price"), F.create_map(F.lit("price"), F.lit("1")))
    retries.retry(fx.spark, "trades", required, good, bad, 60, lambda due: due.withColumn("fields", F.when(odd, priced).otherwise(F.col("fields"))))
    names = ["tradeId", "symbol", "userId", "side", "quantity", "timestamp"]
    kept = fx.spark.read.parquet(good)
    delivered = kept.select(F.lit("good").alias("outcome"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("int").alias("attempts"),
                            F.when(F.col("batch") < 0, F.col("price").cast("string")).otherwise("as sent").alias("price"),
                            *[F.col(c).cast("bigint" if c == "quantity" else kept.schema[c].dataType).cast("string").alias(c) for c in names])
    waiting = retries.quarantined(fx.spark, bad).join(kept.select("message_id"), "message_id", "left_anti").withColumn("f", F.from_json("payload", retries.FIELDS))
    return delivered.unionByName(waiting.select(F.lit("bad").alias("outcome"), "error", "attempts", F.col("f")["price"].alias("price"), *[F.col("f")[c].alias(c) for c in names]))


@query("topic_fanout_sink", "SELECT 'chain:1:' || symbol AS topic, count(*) AS n, max(seq) AS newest FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY seq DESC) AS rn FROM fx_trades) WHERE rn <= 1000 GROUP BY 1")
def topic_fanout_sink(fx):
    """Every trade to its topic folder as JSON, then the retention job of the capped topics."""
    path = scratch_path(fx.spark, "topics")
    streams.run(live(fx).trades, "fanout", each=streams.topic_fanout(streams.topic_key(1, F.col("symbol")), path))
    return streams.topic_trim(fx.spark.read.parquet(path)).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("newest"))


_K = f"""SELECT chain_id, symbol, open_time, close_time, open, high, low, close, volume, quote_volume, trade_count, taker_buy_base_volume FROM fx_klines WHERE interval = '{{i}}'"""


def _klines(fx, interval):
    """Update-mode candles, newest version per (chain, symbol, open time)."""
    path, _ = streams.run(streams.stream_klines(live(fx).trades, interval), "candles", "update")
    return rounded(streams.read_latest(fx.spark, path, ["chain_id", "symbol", "open_time"]), "volume quote_volume taker_buy_base_volume")


query("stream_klines", _K.format(i="1h"))(lambda fx: _klines(fx, "1 hour"))
query("stream_klines_1m", _K.format(i="1m"))(lambda fx: _klines(fx, "1 minute"))


def _sunk(fx, df, name, merge):
    """Drained into a compacted table."""
    path = scratch_path(fx.spark, name)
    streams.run(df, name, each=stateful.merged_sink(path, merge), path=path)
    return path


@query("stream_depth", "SELECT chain_id, pool_id, side, price, quantity, order_count FROM fx_depth_inc WHERE quantity > 0")
def stream_depth(fx):
    return stateful.read_depth(fx.spark, _sunk(fx, stateful.stream_depth(live(fx).event_log), "depth", stateful.merge_levels))


query("stream_trades", """SELECT 'trade' AS event, ts * 1000 AS event_ms, upper(symbol) AS symbol, trade_id, price, quantity, side = 'Sell' AS buyer_is_maker FROM fx_trades""")(
    lambda fx: drained(fx, streams.stream_trades(live(fx).trades), "ticks"))
query("stream_user_trades", """SELECT 'userTrade' AS event, ts * 1000 AS event_ms, user_id, upper(symbol) AS symbol, trade_id, price, quantity, upper(side) AS side,
  round(price * quantity * 0.002, 6) AS commission, 'USDT' AS commission_asset, side = 'Buy' AS is_buyer FROM fx_trades""")(
    lambda fx: drained(fx, streams.stream_user_trades(live(fx).trades), "private").withColumn("commission", r("commission", 6)))


@query("stream_execution_reports", """SELECT user_id, order_id, upper(symbol) AS symbol, upper(side) AS side, upper(status) AS status, round(filled * price, 2) AS cumulative_quote,
  round(filled * price * CASE WHEN is_maker THEN 0.001 ELSE 0.002 END + 1e-9, 4) AS commission, 'usd' AS commission_asset, status IN ('OPEN', 'PARTIALLY_FILLED') AS is_working FROM (
  SELECT cast(u AS varchar) AS user_id, e AS order_id, pool || '/usd' AS symbol, CASE WHEN e % 2 = 0 THEN 'Buy' ELSE 'Sell' END AS side, value AS price, e % 3 = 0 AS is_maker,
   CASE e % 4 WHEN 0 THEN 'OPEN' WHEN 1 THEN 'PARTIALLY_FILLED' WHEN 2 THEN 'FILLED' ELSE 'CANCELLED' END AS status, CASE e % 4 WHEN 1 THEN q // 2 WHEN 2 THEN q ELSE 0 END AS filled FROM fx_base)""")
def stream_execution_reports(fx):
    m = F.col("e") % 4
    orders = live(fx).base.select(
        F.col("u").cast("string").alias("user_id"), F.col("e").alias("order_id"), F.concat("pool", F.lit("/usd")).alias("symbol"),
        F.when(F.col("e") % 2 == 0, "Buy").otherwise("Sell").alias("side"), F.lit("Limit").alias("type"),
        F.when(m == 0, "OPEN").when(m == 1, "PARTIALLY_FILLED").when(m == 2, "FILLED").otherwise("CANCELLED").alias("status"),
        F.col("value").alias("price"), F.col("q").alias("quantity"),
        F.when(m == 1, F.floor(F.col("q") / 2)).when(m == 2, F.col("q")).otherwise(F.lit(0)).alias("filled"),
        (F.col("e") % 3 == 0).alias("is_maker"), F.col("t").alias("ts"))
    out = drained(fx, streams.stream_execution_reports(orders), "reports").withColumn("cumulative_quote", r("cumulative_quote", 2))
    return rounded(out, four="commission").select("user_id", "order_id", "symbol", "side", "status", "cumulative_quote", "commission",
                                                  F.lower("commission_asset").alias("commission_asset"), "is_working")


@query("stream_balances", "SELECT chain_id, user_id, currency, amount AS available, locked, last_updated AS timestamp FROM fx_balances")
def stream_balances(fx):
    path = _sunk(fx, stateful.stream_balances(live(fx).ledger_events), "balances", stateful.merge_balances)
    return stateful.read_merged(fx.spark, path, stateful.merge_balances).drop("_batch")


query("stream_mini_ticker", """SELECT chain_id, symbol, as_of, arg_max(price, seq) AS close, max(price) AS high, min(price) AS low, round(sum(quantity) + 1e-9, 2) AS volume, count(*) AS trade_count
  FROM (SELECT *, unnest(range(ts - ts % 60 + 60, ts - ts % 60 + 86401, 60)) AS as_of FROM fx_trades) WHERE as_of <= (SELECT (max(ts) - 600) // 60 * 60 FROM fx_trades) GROUP BY 1, 2, 3""")(
    lambda fx: rounded(drained(fx, stateful.stream_mini_ticker(live(fx).trades), "ticker"), "volume"))


PER_FILE = 1_000_000  # trades in one file of a piece


def _in_pieces(fx):
    """The trades as a stream of four pieces in time order; every fiftieth arrives with the last piece, whatever its time.

    A piece is one file per million trades of a mean piece, so that larger tables make more tasks.
    """
    path, t = scratch_path(fx.spark, "pieces"), fx.trades
    lo, hi, n = t.agg(F.min("ts"), F.max("ts"), F.count(F.lit(1))).head()
    files = max(1, -(-n // (4 * PER_FILE)))
    piece = F.when(F.col("trade_id") % 50 == 0, 3).otherwise(F.least(F.lit(3), F.floor((F.col("ts") - lo) * 4 / (hi - lo + 1))))
    for k in range(4):
        mine = t.filter(piece == k)
        (mine.coalesce(1) if files == 1 else mine.repartition(files)).write.parquet(f"{path}/p{k}")
    reader = fx.spark.readStream.schema(t.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true")
    return reader.parquet(path)


@query("stream_klines_late", _K.format(i="1h"))
def stream_klines_late(fx):
    """Candles of a stream with late trades, repaired: the batch answer."""
    path = scratch_path(fx.spark, "late-candles")
    streams.run(_in_pieces(fx), "late-candles", each=late.candles_with_late_rows(path, 3600), path=path)
    late.repair_candles(fx.spark, path, 3600)
    rows = late.read_candles(fx.spark, path, with_open=True).withColumn("close_time", F.col("open_time") + 3599).drop("first_seq", "last_seq")
    return rounded(rows, "volume quote_volume taker_buy_base_volume")


query("stream_price_updates", "SELECT token, price, coalesce(decimals, 18) AS decimals, coalesce(source, 'CHAINLINK') AS source, ts FROM fx_oracle_events")(
    lambda fx: drained(fx, streams.stream_price_updates(live(fx).oracle_events), "prices"))
query("stream_lending_events", "SELECT lower(action) AS action, user_id AS user, token, amount, CASE WHEN action = 'LIQUIDATE' THEN liquidator END AS liquidator, ts FROM fx_lending_raw")(
    lambda fx: drained(fx, streams.stream_lending_events(live(fx).lending_raw), "lending"))
query("stream_liquidations", "SELECT user_id AS liquidated_user, liquidator, token AS collateral_token, debt_token, amount AS debt_amount, ts FROM fx_lending_raw WHERE action = 'LIQUIDATE'")(
    lambda fx: drained(fx, streams.stream_liquidations(live(fx).lending_raw), "liquidations"))
query("stream_yield", "SELECT user_id AS user, token, CASE WHEN action = 'SUPPLY' THEN 'lending' ELSE 'borrowing' END AS yield_type, interest AS amount, ts FROM fx_lending_raw")(
    lambda fx: drained(fx, streams.stream_yield(live(fx).lending_raw.withColumn("yield_type", F.when(F.col("action") == "SUPPLY", "LENDING").otherwise("BORROWING"))
                                                .drop("amount").withColumnRenamed("interest", "amount")), "yield"))


@query("stream_dedup", "SELECT trade_id, symbol, ts, price FROM fx_trades")
def stream_dedup(fx):
    """Every message delivered twice, some late: written once each."""
    path = scratch_path(fx.spark, "dedup")
    twice = _in_pieces(fx).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    streams.run(twice, "dedup", each=late.dedup_with_late_rows(path, ["trade_id"]), path=path)
    late.repair_dedup(fx.spark, path, ["trade_id"])
    return late.read_deduped(fx.spark, path).select("trade_id", "symbol", "ts", "price")


@query("stream_lag_report", "SELECT 'ticks' AS query, count(*) AS length, count(*) AS read, 0 AS pending FROM fx_trades")
def stream_lag_report(fx):
    """Every progress event of a drained query, against the length of its source."""
    log = monitor.ProgressLog(fx.spark, scratch_path(fx.spark, "progress"))
    fx.spark.streams.addListener(log)
    try:
        _, q = streams.run(streams.stream_trades(live(fx).trades), "ticks", name="ticks")
        log.wait_for(str(q.runId))
    finally:
        fx.spark.streams.removeListener(log)
    lengths = fx.trades.groupBy(F.lit("ticks").alias("query")).agg(F.count(F.lit(1)).alias("length"))
    return monitor.lag_report(monitor.read_progress(fx.spark, log.path), lengths, AS_OF).select("query", "length", "read", "pending")
