"""Sources, sinks, upserts, data quality, rate limiting and monitoring queries."""

from pyspark.sql import functions as F

from tickforge.fixtures import AS_OF
from tickforge.functions.columns import r
from tickforge.operators import keyed
from tickforge.plans import ledger, limits, quality, volume
from tickforge.registry.core import query, r2, r4, rounded, view
from tickforge.session import scratch_path
from tickforge.sources import event_log, tables

# --- scans and filters ---------------------------------------------------------------------------
B0, B1 = AS_OF - 20 * 86400, AS_OF - 10 * 86400
_LOGCOLS = "event_name, address, block_number, log_index, order_id, price, quantity"


def _cols(df):
    return df.select(*[c.strip() for c in _LOGCOLS.split(",")])


query("scan_events", f"SELECT {_LOGCOLS} FROM fx_log WHERE event_name IN ('OrderPlaced', 'OrderCancelled') AND block_number BETWEEN {B0} AND {B1} AND chain_id = 1")(
    lambda fx: _cols(event_log.scan_events(fx.event_log, ["OrderPlaced", "OrderCancelled"], B0, B1, 1)))


@query("scan_events_stored", f"SELECT {_LOGCOLS} FROM fx_log WHERE event_name = 'OrderMatched' AND block_number BETWEEN {B0} AND {B1}")
def scan_events_stored(fx):
    """The same scan on a stored log: one folder per event, row groups pruned by block."""
    path = scratch_path(fx.spark, "event-log")
    event_log.write_event_log(fx.event_log, path)
    return _cols(event_log.scan_events(event_log.read_event_log(fx.spark, path), ["OrderMatched"], B0, B1))


query("factory_filter", f"SELECT {_LOGCOLS} FROM fx_log WHERE address IN (SELECT order_book FROM fx_pools WHERE order_book <> 'error')")(
    lambda fx: _cols(event_log.factory_filter(
        fx.event_log, fx.pools.filter(F.col("order_book") != "error").withColumn("order_book", F.upper("order_book")))))
query("live_gate", f"SELECT {_LOGCOLS} FROM fx_log WHERE block_number >= {B1}")(lambda fx: _cols(event_log.live_gate(fx.event_log, B1)))
query("scan_state_tables", f"""SELECT 'pools' AS table_name, count(*) AS records FROM fx_pools UNION ALL SELECT 'depth', count(*) FROM fx_depth
  UNION ALL SELECT 'trades', count(*) FROM fx_trades WHERE ts >= {B0}""")(
    lambda fx: quality.table_counts({"pools": fx.pools, "depth": fx.depth, "trades": event_log.scan_state_table(fx.trades, "ts", B0)})
    .select("table_name", F.col("row_count").alias("records")))


@query("static_pool_json", """SELECT 'p' || p_partkey AS id, 1 AS chain_id, p_name AS coin, '0xbook' || p_partkey AS order_book, p_size AS base_decimals,
  cast(p_retailprice AS varchar) AS price, '0xaa' || p_partkey AS base_address, p_brand AS base_symbol, p_type AS quote_symbol FROM part""")
def static_pool_json(fx):
    """Documents of at most a thousand nested pools, one per line, read back flat."""
    k = F.col("p_partkey").cast("string")
    currency = lambda addr, sym: F.struct(addr.alias("address"), F.lit(1).alias("chainId"), F.lit(18).alias("decimals"),
                                          F.col("p_name").alias("name"), addr.alias("id"), sym.alias("symbol"))
    item = F.struct(F.concat(F.lit("p"), k).alias("id"), F.lit(1).alias("chainId"), F.col("p_name").alias("coin"),
                    F.concat(F.lit("0xbook"), k).alias("orderBook"), F.col("p_size").alias("baseDecimals"),
                    F.lit(6).alias("quoteDecimals"), F.col("p_retailprice").cast("string").alias("price"),
                    currency(F.concat(F.lit("0xAA"), k), F.col("p_brand")).alias("baseCurrency"),
                    currency(F.concat(F.lit("0xBB"), k), F.col("p_type")).alias("quoteCurrency"))
    docs = fx.table("part").groupBy(F.floor(F.col("p_partkey") / 1000)).agg(F.collect_list(item).alias("items")).select(
        F.to_json(F.struct(F.struct(F.struct("items").alias("poolss")).alias("data"))).alias("value"))
    path = scratch_path(fx.spark, "pools-json")
    docs.write.text(path)
    return event_log.static_pool_json(fx.spark, path, multi_line=False).select(
        "id", "chain_id", "coin", "order_book", "base_decimals", "price", "base_address", "base_symbol", "quote_symbol")


view("fx_ticks", """SELECT symbol AS source, ts - ts % 3600 AS ts, cast(sum(quantity) AS bigint) AS messages, count(*) AS orders FROM fx_trades GROUP BY 1, 2""")
view("fx_counters", """SELECT source, ts, cast(sum(messages) OVER w AS bigint) AS messages, cast(sum(orders) OVER w AS bigint) AS orders FROM fx_ticks
  WINDOW w AS (PARTITION BY source ORDER BY ts ROWS UNBOUNDED PRECEDING)""")


def _ticks(fx):
    """Monitoring ticks: one entry per symbol and hour."""
    return fx.trades.groupBy(F.col("symbol").alias("source"), (F.col("ts") - F.col("ts") % 3600).alias("ts")).agg(
        F.sum("quantity").cast("long").alias("messages"), F.count(F.lit(1)).alias("orders"))


def _counters(fx):
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    return _ticks(fx).select("source", "ts", F.sum("messages").over(w).alias("messages"), F.sum("orders").over(w).alias("orders"))


@query("read_metrics_jsonl", "SELECT ts, cast(sum(messages) AS bigint) AS messages, cast(sum(orders) AS bigint) AS orders FROM fx_ticks GROUP BY 1 ORDER BY ts DESC LIMIT 50")
def read_metrics_jsonl(fx):
    path = scratch_path(fx.spark, "metrics")
    _ticks(fx).groupBy("ts").agg(F.sum("messages").alias("messages"), F.sum("orders").alias("orders")).write.json(path)
    return event_log.read_metrics_jsonl(fx.spark, path, 50).select("ts", "messages", "orders")


query("metrics_trend", """SELECT source, ts, messages, orders, messages - lag(messages) OVER w AS messages_change, orders - lag(orders) OVER w AS orders_change FROM fx_ticks
  WINDOW w AS (PARTITION BY source ORDER BY ts)""")(lambda fx: quality.metrics_trend(_ticks(fx), ["messages", "orders"]))
query("counter_rate", f"""SELECT source, {r4('(max(messages) - min(messages)) / ((max(ts) - min(ts)) / 60)', 'messages_per_minute')}, {r4('(max(orders) - min(orders)) / ((max(ts) - min(ts)) / 60)', 'orders_per_minute')}
  FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC) AS rn FROM fx_counters) WHERE rn <= 3 GROUP BY 1""")(
    lambda fx: rounded(quality.counter_rate(_counters(fx), ["messages", "orders"]), four="messages_per_minute orders_per_minute"))

# --- upserts -------------------------------------------------------------------------------------
# Target: each user's trades of the first half of the month folded to one row; batch: the rest.
MID = AS_OF - 15 * 86400
view("fx_target", f"SELECT user_id, symbol, arg_max(price, seq) AS price, max(seq) AS seq FROM fx_trades WHERE ts < {MID} GROUP BY 1, 2")
_batch = lambda fx: fx.trades.filter(F.col("ts") >= MID).select("user_id", "symbol", "price", "seq")
_target = lambda fx: keyed.latest_per_key(fx.trades.filter(F.col("ts") < MID).select("user_id", "symbol", "price", "seq"), ["user_id", "symbol"], "seq")
query("insert_ignore", f"""SELECT * FROM fx_target UNION ALL SELECT user_id, symbol, arg_min(price, seq), min(seq) FROM fx_trades t WHERE ts >= {MID}
  AND NOT EXISTS (SELECT 1 FROM fx_target x WHERE x.user_id = t.user_id AND x.symbol = t.symbol) GROUP BY 1, 2""")(
    lambda fx: keyed.insert_ignore(_target(fx), _batch(fx), ["user_id", "symbol"], "seq"))
query("upsert_replace", "SELECT user_id, symbol, arg_max(price, seq) AS price, max(seq) AS seq FROM fx_trades GROUP BY 1, 2")(
    lambda fx: keyed.upsert_replace(_target(fx), _batch(fx), ["user_id", "symbol"], "seq"))
query("upsert_merge_add", """SELECT user_id, symbol, count(*) AS n, cast(sum(quantity) AS bigint) AS qty, min(ts) AS first_ts, max(ts) AS last_ts FROM fx_trades GROUP BY 1, 2""")(
    lambda fx: keyed.upsert_merge_add(*[
        fx.trades.filter(cond).groupBy("user_id", "symbol").agg(
            F.count(F.lit(1)).alias("n"), F.sum("quantity").cast("long").alias("qty"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
        for cond in (F.col("ts") < MID, F.col("ts") >= MID)], ["user_id", "symbol"], ["n", "qty"], ["first_ts"], ["last_ts"]))
query("upsert_coalesce", """SELECT message_id, s.user_id AS sender, t.user_id AS relayer, coalesce(s.ts, t.ts) AS ts FROM (SELECT * FROM fx_bridge_messages WHERE type = 'DISPATCH') s
  FULL JOIN (SELECT * FROM fx_bridge_messages WHERE type = 'PROCESS') t USING (message_id)""")(
    lambda fx: keyed.upsert_coalesce(
        fx.bridge_messages.filter("type = 'DISPATCH'").select("message_id", F.col("user_id").alias("sender"), "ts"),
        fx.bridge_messages.filter("type = 'PROCESS'").select("message_id", F.col("user_id").alias("relayer"), "ts"), ["message_id"])
    .select("message_id", "sender", "relayer", "ts"))

# --- stored buckets ------------------------------------------------------------------------------
_agg = lambda df: rounded(volume.trade_aggregates_hourly(df), "volume", "avg_price").withColumnRenamed("timestamp", "bucket")
view("fx_buckets", "SELECT timestamp AS bucket, * EXCLUDE timestamp FROM fx_aggregates")


@query("replace_bucket", "SELECT * FROM fx_buckets")
def replace_bucket(fx):
    """Everything once, then the last ten days again: the second run must change nothing."""
    path = scratch_path(fx.spark, "buckets")
    tables.replace_bucket(_agg(fx.trades), path)
    tables.replace_bucket(_agg(fx.trades.filter(F.col("ts") >= AS_OF - 10 * 86400)), path)
    return tables.read_table(fx.spark, path).drop("date")


@query("incremental_bucket_refresh", "SELECT * FROM fx_buckets")
def incremental_bucket_refresh(fx):
    """A stale table (last days built from half the trades) repaired by refreshing its recent days."""
    path = scratch_path(fx.spark, "refresh")
    cut = AS_OF - 4 * 86400
    tables.replace_bucket(_agg(fx.trades.filter((F.col("ts") < cut) | F.col("is_buyer"))), path)
    tables.incremental_bucket_refresh(fx.trades, path, _agg, AS_OF, "1h", 5 * 86400)
    return tables.read_table(fx.spark, path).drop("date")


@query("incremental_since_max", "SELECT * FROM fx_buckets")
def incremental_since_max(fx):
    """Half the month stored, then everything from the newest stored bucket on."""
    path = scratch_path(fx.spark, "since")
    tables.replace_bucket(_agg(fx.trades.filter(F.col("ts") < MID + 1800)), path)
    tables.incremental_since_max(fx.trades, path, _agg)
    return tables.read_table(fx.spark, path).drop("date")


query("retention_delete", f"SELECT * FROM fx_buckets WHERE bucket >= {AS_OF - 14 * 86400}")(
    lambda fx: tables.retention_filter(_agg(fx.trades), "bucket", 14 * 86400, AS_OF))


@query("backup_table", "SELECT * FROM fx_buckets")
def backup_table(fx):
    path = scratch_path(fx.spark, "table")
    tables.replace_bucket(_agg(fx.trades), path)
    copy = tables.backup_table(fx.spark, path, "20240131")
    return fx.spark.read.parquet(copy).drop("date")


# --- data quality --------------------------------------------------------------------------------
view("fx_done", "SELECT DISTINCT trade_id FROM fx_sync_log WHERE status = 'processed' AND service = 'analytics'")
query("missed_trades", f"SELECT trade_id, symbol, ts, price, quantity FROM fx_trades WHERE ts > {AS_OF - 25 * 86400} AND trade_id NOT IN (SELECT trade_id FROM fx_done)")(
    lambda fx: quality.missed_trades(fx.trades, fx.sync_log, AS_OF - 25 * 86400).select("trade_id", "symbol", "ts", "price", "quantity"))
view("fx_gaps", """SELECT CASE WHEN to_ts = (SELECT max(ts) FROM fx_trades) THEN 'tail' WHEN from_ts = (SELECT min(ts) FROM fx_trades) THEN 'head' ELSE 'middle' END AS type,
  from_ts, to_ts, trade_count FROM (SELECT min(ts) AS from_ts, max(ts) AS to_ts, cast(sum(n) AS bigint) AS trade_count FROM (
   SELECT ts, n, done, row_number() OVER (ORDER BY ts) - row_number() OVER (PARTITION BY done ORDER BY ts) AS g FROM (
    SELECT ts, count(*) AS n, bool_or(trade_id IN (SELECT trade_id FROM fx_done)) AS done FROM fx_trades GROUP BY 1)) WHERE NOT done GROUP BY g)""")
query("data_gaps", "SELECT * FROM fx_gaps")(lambda fx: quality.data_gaps(fx.trades, fx.sync_log))
query("missed_trades_in_gaps", """SELECT t.trade_id, t.symbol, t.ts, t.price, t.quantity FROM fx_gaps g JOIN fx_trades t ON t.ts BETWEEN g.from_ts AND g.to_ts
  WHERE trade_id NOT IN (SELECT trade_id FROM fx_done)""")(
    lambda fx: quality.missed_trades_in_gaps(fx.trades, quality.data_gaps(fx.trades, fx.sync_log), fx.sync_log).select(
        "trade_id", "symbol", "ts", "price", "quantity"))
_LAST = "SELECT coalesce((SELECT max(ts) FROM fx_trades WHERE trade_id IN (SELECT trade_id FROM fx_done)), (SELECT min(ts) FROM fx_trades))"
_CONT = "SELECT count(*) > 0 FROM fx_trades WHERE ts = (SELECT min(ts) FROM fx_trades) AND trade_id IN (SELECT trade_id FROM fx_done)"
query("last_processed_ts", _LAST + " AS last_processed_ts")(lambda fx: quality.last_processed_ts(fx.trades, fx.sync_log))
query("continuous_from_start", _CONT.replace("> 0 FROM", "> 0 AS continuous_from_start FROM"))(lambda fx: quality.continuous_from_start(fx.trades, fx.sync_log))
view("fx_integrity", """SELECT total_trades, processed_trades, integrity_score, CASE WHEN integrity_score >= 98 THEN 'excellent' WHEN integrity_score >= 95 THEN 'good'
  WHEN integrity_score >= 90 THEN 'fair' ELSE 'poor' END AS status FROM (SELECT count(*) AS total_trades, count(d.trade_id) AS processed_trades,
  round(count(d.trade_id) / count(*) * 100, 2) AS integrity_score FROM fx_trades t LEFT JOIN fx_done d ON d.trade_id = t.trade_id)""")
query("integrity_score", "SELECT * FROM fx_integrity")(lambda fx: quality.integrity_score(fx.trades, fx.sync_log))
query("sync_health", f"""SELECT latest_trade_ts, last_processed_ts, round((latest_trade_ts - last_processed_ts) / 60, 4) AS lag_minutes, total_gaps, tail_gaps, middle_gaps, missed_trades,
  integrity_score, continuous_from_start, false AS is_cold_start, CASE WHEN middle_gaps > 0 OR integrity_score < 95 THEN 'COMPREHENSIVE_SYNC_REQUIRED'
   WHEN (latest_trade_ts - last_processed_ts) / 60 > 60 THEN 'IMMEDIATE_SYNC_REQUIRED' WHEN (latest_trade_ts - last_processed_ts) / 60 > 5 THEN 'SYNC_RECOMMENDED' ELSE 'HEALTHY' END AS recommendation,
  (latest_trade_ts - last_processed_ts) / 60 < 5 AND middle_gaps = 0 AND integrity_score > 98 AS is_healthy
  FROM (SELECT (SELECT max(ts) FROM fx_trades) AS latest_trade_ts, ({_LAST}) AS last_processed_ts, (SELECT count(*) FROM fx_gaps) AS total_gaps,
   (SELECT count(*) FROM fx_gaps WHERE type = 'tail') AS tail_gaps, (SELECT count(*) FROM fx_gaps WHERE type = 'middle') AS middle_gaps,
   (SELECT cast(sum(trade_count) AS bigint) FROM fx_gaps) AS missed_trades, (SELECT integrity_score FROM fx_integrity) AS integrity_score, ({_CONT}) AS continuous_from_start)""")(
    lambda fx: quality.sync_health(fx.trades, fx.sync_log))
query("cold_start_analysis", f"""SELECT total_trades, recent_trades, earliest, latest, round((latest - earliest) / 86400, 4) AS span_days,
  CASE WHEN total_trades < 1000 THEN 'full' WHEN total_trades < 100000 THEN 'recent' ELSE 'skip-historical' END AS recommended_strategy,
  cast(ceil(total_trades / 100) AS bigint) AS full_sync_seconds, cast(ceil(recent_trades / 100) AS bigint) AS recent_sync_seconds FROM
  (SELECT count(*) AS total_trades, count(*) FILTER (WHERE ts >= {AS_OF - 7 * 86400}) AS recent_trades, min(ts) AS earliest, max(ts) AS latest FROM fx_trades)""")(
    lambda fx: quality.cold_start_analysis(fx.trades, AS_OF).drop("full_sync_text"))
query("sync_mark", f"""SELECT trade_id, service, 'processed' AS status, CASE WHEN status = 'processed' THEN processed_at ELSE {AS_OF} END AS processed_at FROM fx_sync_log""")(
    lambda fx: quality.sync_mark(fx.sync_log, quality.missed_trades(fx.trades, fx.sync_log, -1), "processed", AS_OF))
query("trade_transform", "SELECT trade_id, symbol, price, quantity, side, ts, round(price * quantity, 2) AS volume FROM fx_trades")(
    lambda fx: quality.trade_transform(fx.trades).withColumn("volume", r("volume", 2)))
query("sync_run", f"""SELECT 'comprehensive' AS strategy, (SELECT cast(sum(trade_count) AS bigint) FROM fx_gaps) AS marked_trades, (SELECT count(*) FROM fx_aggregates
  WHERE timestamp // 86400 IN (SELECT ts // 86400 FROM fx_trades WHERE trade_id NOT IN (SELECT trade_id FROM fx_done))) AS aggregate_rows, 100.0::double AS integrity_after""")(
    lambda fx: quality.sync_run(fx.trades, fx.sync_log, scratch_path(fx.spark, "sync"), AS_OF))
query("table_counts", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count, CASE WHEN count(*) > 0 THEN 'ok' ELSE 'empty' END AS status FROM {v}" for n, v in (
    ("pools", "fx_pools"), ("orders", "fx_orders"), ("order_history", "fx_order_history"), ("order_book_depth", "fx_depth"), ("trades", "fx_order_trades"), ("balances", "fx_balances"))))(
    lambda fx: quality.table_counts({"pools": fx.pools, "orders": fx.orders, "order_history": fx.order_history, "order_book_depth": fx.depth,
                                     "trades": fx.order_trades, "balances": ledger.balance_ledger(fx.ledger_events)}))

# --- rate limiting -------------------------------------------------------------------------------
W, C = 86400, 4 * 86400  # a day's window, because the test users act every few hours
view("fx_requests", "SELECT user_id AS identifier, ts, seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, seq) AS rn FROM fx_trades")
query("rate_limit", f"""SELECT identifier, ts, seq, allowed, reason, remaining, reset_ts FROM (WITH RECURSIVE s AS (
   SELECT identifier, ts, seq, rn, ts AS w, 1 AS n, cast(0 AS bigint) AS until, true AS allowed, cast(NULL AS varchar) AS reason, 2 AS remaining, ts + {W} AS reset_ts FROM fx_requests WHERE rn = 1
   UNION ALL SELECT r.identifier, r.ts, r.seq, r.rn, CASE WHEN fresh THEN r.ts ELSE w END, CASE WHEN fresh THEN 1 WHEN ok THEN n + 1 ELSE n END,
    CASE WHEN NOT fresh AND ok AND n = 2 THEN r.ts + {C} ELSE until END, fresh OR ok,
    CASE WHEN fresh OR ok THEN NULL WHEN r.ts - w <= {W} THEN 'RATE_LIMIT' ELSE 'COOLDOWN' END,
    CASE WHEN fresh THEN 2 WHEN ok THEN 2 - n ELSE 0 END,
    CASE WHEN fresh THEN r.ts + {W} WHEN ok OR r.ts - w <= {W} THEN w + {W} ELSE until END
   FROM (SELECT r.*, s.w, s.n, s.until, r.ts - s.w > {W} AND r.ts >= s.until AS fresh, r.ts - s.w <= {W} AND s.n < 3 AS ok FROM s JOIN fx_requests r ON r.identifier = s.identifier AND r.rn = s.rn + 1) r)
  SELECT * FROM s)""")(
    lambda fx: limits.rate_limit(fx.trades.select(F.col("user_id").alias("identifier"), "ts", "seq"), 3, W, C))

# Six users share two addresses of the network each way, so both limiters refuse requests that the other would let pass.
view("fx_asked", """SELECT 'A' || u AS address, 'ip' || (u // 6 * 2 + e % 2) AS ip, ts, seq, u // 6 AS g, row_number() OVER (PARTITION BY u // 6 ORDER BY ts, seq) AS rn
  FROM (SELECT cast(user_id AS bigint) AS u, trade_id AS e, ts, seq FROM fx_trades)""")
_state = lambda s: f"CASE WHEN {s}.w IS NULL OR (ts - {s}.w > {W} AND ts >= {s}.until) THEN 'new' WHEN ts - {s}.w <= {W} AND {s}.n < 3 THEN 'more' WHEN ts - {s}.w <= {W} THEN 'spent' ELSE 'cooling' END"
_next = lambda s, k: f"CASE WHEN {k} = 'new' THEN {{'w': ts, 'n': 1, 'until': 0}} ELSE {{'w': {s}.w, 'n': {s}.n + 1, 'until': CASE WHEN {s}.n = 2 THEN ts + {C} ELSE 0 END}} END"
_passes = "ka IN ('new', 'more') AND ki IN ('new', 'more')"
query("rate_limit_both", f"""SELECT lower(address) AS address, ip, ts, seq, allowed, reason, remaining, reset_ts FROM (WITH RECURSIVE s AS (
   SELECT g, cast(0 AS bigint) AS rn, cast(MAP {{}} AS MAP(VARCHAR, STRUCT(w BIGINT, n INTEGER, until BIGINT))) AS m, cast(NULL AS varchar) AS address, cast(NULL AS varchar) AS ip,
    cast(NULL AS bigint) AS ts, cast(NULL AS bigint) AS seq, false AS allowed, cast(NULL AS varchar) AS reason, cast(0 AS bigint) AS remaining, cast(0 AS bigint) AS reset_ts FROM (SELECT DISTINCT g FROM fx_asked)
   UNION ALL SELECT g, rn, CASE WHEN {_passes} THEN map_concat(m, MAP {{address: na, ip: ni}}) ELSE m END, address, ip, ts, seq, {_passes},
    CASE WHEN ka = 'spent' THEN 'ADDRESS_RATE_LIMIT' WHEN ki = 'spent' THEN 'IP_RATE_LIMIT' WHEN ka = 'cooling' THEN 'ADDRESS_COOLDOWN' WHEN ki = 'cooling' THEN 'IP_COOLDOWN' END,
    CASE WHEN {_passes} THEN 3 - greatest(na.n, ni.n) ELSE 0 END,
    CASE WHEN ka = 'spent' THEN a.w + {W} WHEN ki = 'spent' THEN i.w + {W} WHEN ka = 'cooling' THEN a.until WHEN ki = 'cooling' THEN i.until ELSE least(na.w, ni.w) + {W} END
   FROM (SELECT *, {_next('a', 'ka')} AS na, {_next('i', 'ki')} AS ni FROM (SELECT *, {_state('a')} AS ka, {_state('i')} AS ki FROM (
    SELECT r.*, s.m, s.m[r.address] AS a, s.m[r.ip] AS i FROM s JOIN fx_asked r ON r.g = s.g AND r.rn = s.rn + 1)))) SELECT * FROM s WHERE rn > 0)""")(
    lambda fx: limits.both_limits(fx.trades.select(
        F.concat(F.lit("A"), "user_id").alias("address"), "ts", "seq",
        F.concat(F.lit("ip"), (F.expr("cast(user_id as bigint) div 6 * 2") + F.col("trade_id") % 2).cast("string")).alias("ip")), 3, W, C))
