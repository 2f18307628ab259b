"""Order-book folds, depth and candles."""

from pyspark.sql import functions as F

from tickforge.fixtures import AS_OF
from tickforge.functions.columns import r
from tickforge.plans import books, orders, trades
from tickforge.registry.core import nudged, query, view

query("fold_orders_placed", "SELECT * FROM fx_placed")(lambda fx: orders.fold_orders_placed(fx.event_log))

query("explode_fills", """SELECT fill_id, chain_id, pool_id, side, order_id, is_maker, price, quantity, ts, block_number,
  log_index, tx_hash, seq FROM fx_order_trades""")(lambda fx: fx.order_trades)

query("order_fill_progress", """SELECT p.chain_id, p.pool_id, p.order_id, p.quantity, cast(coalesce(sum(t.quantity), 0) AS bigint) AS filled,
  CASE WHEN count(t.quantity) = 0 THEN any_value(p.status) WHEN sum(t.quantity) = p.quantity THEN 'FILLED'
    ELSE 'PARTIALLY_FILLED' END AS status
  FROM fx_placed p LEFT JOIN fx_order_trades t ON t.chain_id = p.chain_id AND t.pool_id = p.pool_id AND t.order_id = p.order_id
  GROUP BY p.chain_id, p.pool_id, p.order_id, p.quantity""")(
    lambda fx: orders.order_fill_progress(orders.fold_orders_placed(fx.event_log), fx.order_trades))

query("order_status_updates", """SELECT chain_id, pool_id, order_id, CASE code WHEN 0 THEN 'OPEN' WHEN 1 THEN 'PARTIALLY_FILLED'
  WHEN 2 THEN 'FILLED' WHEN 3 THEN 'CANCELLED' WHEN 4 THEN 'REJECTED' WHEN 5 THEN 'EXPIRED' END AS status, ts
  FROM fx_status_updates""")(lambda fx: orders.order_status_updates(fx.event_log))

query("order_current_state", "SELECT * FROM fx_orders")(lambda fx: fx.orders)

query("order_history_log", "SELECT * FROM fx_order_history")(lambda fx: fx.order_history)

query("trades_enriched", """SELECT chain_id, fill_id, user_id, symbol, pool_id, side, order_id, is_maker, price, quantity,
  round(quote_qty, 2) AS quote_qty, ts, seq, status FROM fx_enriched""")(
    lambda fx: fx.trades_enriched.withColumn("quote_qty", r("quote_qty", 2)))

view("fx_pool_created", """SELECT 1 AS chain_id, '0xPool' || p_partkey AS order_book, '0xTok' || (p_partkey % 97) AS base,
  '0xtok' || (p_partkey % 13 + 90) AS quote, p_partkey AS ts, p_partkey AS seq FROM part""")
view("fx_tokens", """SELECT 1 AS chain_id, CASE WHEN s_suppkey < 95 THEN '0xTOK' ELSE '0xOTHER' END || s_suppkey AS address, 'T' || s_suppkey AS symbol,
  cast(s_suppkey % 18 AS int) AS decimals FROM supplier""")


@query("fold_pools", """SELECT sha256('1_' || order_book) AS id, c.chain_id, order_book, lower(base) AS base, lower(quote) AS quote,
  coalesce(b.symbol, 'UNKNOWN') || '/' || coalesce(q.symbol, 'UNKNOWN') AS coin, coalesce(b.decimals, 18) AS base_decimals,
  coalesce(q.decimals, 18) AS quote_decimals, 0::bigint AS price, 0::bigint AS volume, 0::bigint AS volume_in_quote, ts AS timestamp
  FROM fx_pool_created c LEFT JOIN fx_tokens b ON lower(b.address) = lower(base) LEFT JOIN fx_tokens q ON lower(q.address) = lower(quote)""")
def fold_pools(fx):
    k = F.col("p_partkey")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    created = fx.table("part").select(
        F.lit(1).alias("chain_id"), text("0xPool", k).alias("order_book"), text("0xTok", k % 97).alias("base"),
        text("0xtok", k % 13 + 90).alias("quote"), k.alias("ts"), k.alias("seq"))
    s = F.col("s_suppkey")
    prefix = F.when(s < 95, "0xTOK").otherwise("0xOTHER")  # no pool has the others, so some pools show UNKNOWN
    tokens = fx.table("supplier").select(
        F.lit(1).alias("chain_id"), F.concat(prefix, s.cast("string")).alias("address"), text("T", s).alias("symbol"),
        (s % 18).cast("int").alias("decimals"))
    return orders.fold_pools(created, tokens)


query("pool_running_stats", """SELECT p.chain_id, p.order_book AS pool_id, p.coin, max_by(f.price, f.seq) AS price,
  cast(sum(f.quantity) AS bigint) AS volume, cast(sum(f.quantity * f.price) AS bigint) AS volume_in_quote, max(f.ts) AS timestamp
  FROM fx_pools p JOIN fx_fills f ON f.chain_id = p.chain_id AND f.pool_id = p.order_book GROUP BY 1, 2, 3""")(
    lambda fx: orders.pool_running_stats(fx.pools, fx.fills).withColumn("volume_in_quote", F.col("volume_in_quote").cast("long")))

query("user_stats", """SELECT chain_id, user_id, min(ts) AS first_seen, max(ts) AS last_seen, cast(sum(o) AS bigint) AS total_orders,
  cast(sum(d) AS bigint) AS total_deposits, cast(sum(v) AS double) AS total_volume FROM (
  SELECT chain_id, user_id, block_timestamp AS ts, CASE WHEN event_name = 'OrderPlaced' THEN 1 ELSE 0 END AS o, 0 AS d,
    CASE WHEN event_name = 'OrderMatched' THEN price * quantity ELSE 0 END AS v FROM fx_log WHERE event_name IN ('OrderPlaced', 'OrderMatched')
  UNION ALL SELECT chain_id, user_id, ts, 0, CASE WHEN op = 'deposit' THEN 1 ELSE 0 END, 0 FROM fx_ledger
  UNION ALL SELECT chain_id, receiver, ts, 0, 0, 0 FROM fx_ledger WHERE op LIKE 'transfer%'
  UNION ALL SELECT chain_id, operator, ts, 0, 0, 0 FROM fx_ledger WHERE op LIKE 'transfer%') GROUP BY 1, 2""")(
    lambda fx: orders.user_stats(fx.event_log, fx.ledger_events))

# --- depth ---------------------------------------------------------------------------------------
query("depth_rebuild", "SELECT * FROM fx_depth")(lambda fx: fx.depth)

view("fx_depth_inc", """SELECT chain_id, pool_id, side, price, cast(sum(CASE WHEN gone THEN 0 ELSE rest END) AS bigint) AS quantity,
  count(*) FILTER (WHERE NOT gone) AS order_count, max(last_updated) AS last_updated FROM (
  SELECT p.chain_id, p.pool_id, p.side, p.price, p.quantity - coalesce(f.filled, 0) AS rest,
    coalesce(u.ended, false) OR p.quantity - coalesce(f.filled, 0) <= 0 AS gone,
    greatest(p.ts, coalesce(f.ts, 0), coalesce(u.ts, 0)) AS last_updated FROM fx_placed p
  LEFT JOIN (SELECT chain_id, pool_id, order_id, sum(quantity) AS filled, max(ts) AS ts FROM fx_order_trades GROUP BY 1, 2, 3) f USING (chain_id, pool_id, order_id)
  LEFT JOIN (SELECT chain_id, address AS pool_id, order_id, max(block_timestamp) AS ts, bool_or(status_code >= 3) AS ended FROM fx_log
    WHERE event_name IN ('OrderCancelled', 'UpdateOrder') GROUP BY 1, 2, 3) u USING (chain_id, pool_id, order_id)) GROUP BY 1, 2, 3, 4""")
query("depth_incremental", "SELECT * FROM fx_depth_inc")(lambda fx: books.depth_incremental(fx.event_log))

view("fx_best", """SELECT chain_id, pool_id, side, level, price, quantity, order_count FROM (SELECT *, row_number() OVER (
  PARTITION BY chain_id, pool_id, side ORDER BY CASE WHEN side = 'Buy' THEN -price ELSE price END) AS level FROM fx_depth WHERE price > 0 AND quantity > 0)""")
query("depth_from_orders", "SELECT * FROM fx_best WHERE level <= 100")(lambda fx: books.depth_from_orders(fx.orders, 100))
view("fx_best_any", """SELECT chain_id, pool_id, side, row_number() OVER (PARTITION BY chain_id, pool_id, side ORDER BY CASE WHEN side = 'Buy' THEN -price ELSE price END) AS level,
  price, quantity, order_count FROM fx_depth WHERE quantity > 0""")
query("depth_from_levels", "SELECT * FROM fx_best_any WHERE level <= 20")(lambda fx: books.depth_from_levels(fx.depth, 20))
query("depth_from_raw_events", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, pool_id, side
  ORDER BY CASE WHEN side = 'Buy' THEN -price ELSE price END) AS level FROM (SELECT chain_id, pool_id, side, price,
  cast(sum(quantity) AS bigint) AS quantity, count(*) AS order_count FROM fx_placed WHERE status = 'OPEN' AND price > 0 GROUP BY 1, 2, 3, 4)) WHERE level <= 100""")(
    lambda fx: books.depth_from_raw_events(fx.event_log, 100))
query("current_spread", """SELECT chain_id, pool_id, max(price) FILTER (WHERE side = 'Buy') AS best_bid, min(price) FILTER (WHERE side = 'Sell') AS best_ask,
  min(price) FILTER (WHERE side = 'Sell') - max(price) FILTER (WHERE side = 'Buy') AS spread FROM fx_depth WHERE quantity > 0 GROUP BY 1, 2""")(
    lambda fx: books.current_spread(fx.depth))

view("fx_snapshot", f"""SELECT cast({AS_OF} AS bigint) AS snapshot_ts, d.chain_id, d.pool_id, p.coin AS symbol, d.side, d.price, d.quantity, d.order_count,
  round(d.quantity / pow(10.0, p.base_decimals) * (d.price / pow(10.0, p.quote_decimals)), 2) AS liquidity_value
  FROM fx_depth d JOIN fx_pools p ON p.chain_id = d.chain_id AND p.order_book = d.pool_id WHERE d.quantity > 0 AND d.price > 0""")
_snap = lambda fx: books.book_snapshot(fx.depth, fx.pools, AS_OF).withColumn("liquidity_value", r("liquidity_value", 2))
query("book_snapshot", "SELECT * FROM fx_snapshot")(_snap)

_AGG = """SELECT snapshot_ts, chain_id, pool_id, symbol, round(bl, 2) AS bid_liquidity, round(al, 2) AS ask_liquidity, round(tl, 2) AS total_liquidity,
  bo AS bid_orders, ao AS ask_orders, bb AS best_bid, ba AS best_ask,
  round(CASE WHEN bb > 0 AND ba > bb THEN (ba - bb) / bb ELSE 0.0125 END, 6) AS spread FROM (
  SELECT snapshot_ts, chain_id, pool_id, symbol, sum(CASE WHEN side = 'Buy' THEN liquidity_value ELSE 0.0 END) AS bl,
   sum(CASE WHEN side = 'Sell' THEN liquidity_value ELSE 0.0 END) AS al, sum(liquidity_value) AS tl,
   cast(sum(CASE WHEN side = 'Buy' THEN order_count ELSE 0 END) AS bigint) AS bo,
   cast(sum(CASE WHEN side = 'Sell' THEN order_count ELSE 0 END) AS bigint) AS ao,
   cast(max(CASE WHEN side = 'Buy' THEN price END) AS double) AS bb, cast(min(CASE WHEN side = 'Sell' THEN price END) AS double) AS ba
  FROM {src} GROUP BY 1, 2, 3, 4)"""


def _rounded_book(df):
    for c in ("bid_liquidity", "ask_liquidity", "total_liquidity"):
        df = df.withColumn(c, r(c, 2))
    return (df.withColumn("spread", r("spread", 6)).withColumn("best_bid", F.col("best_bid").cast("double"))
            .withColumn("best_ask", F.col("best_ask").cast("double")))


query("book_snapshot_aggregate", _AGG.format(src="fx_snapshot"))(
    lambda fx: _rounded_book(books.book_snapshot_aggregate(_snap(fx))))

# --- hourly book history -------------------------------------------------------------------------
HISTORY_UNTIL = AS_OF
view("fx_order_hours", f"""SELECT h.chain_id, h.pool_id, h.order_id, o.side, o.price, o.quantity, h.ts, h.seq,
  CASE WHEN h.status IN ('NEW', 'OPEN', 'PARTIALLY_FILLED') THEN greatest(o.quantity - max(h.filled) OVER w, 0) ELSE 0 END AS rem,
  coalesce(lead(h.ts) OVER w, 9999999999) AS until FROM fx_order_history h JOIN fx_orders o USING (chain_id, pool_id, order_id)
  WHERE o.price > 0 WINDOW w AS (PARTITION BY h.chain_id, h.pool_id, h.order_id ORDER BY h.seq)""")
view("fx_all_hours", f"SELECT unnest(range(min(ts) - min(ts) % 3600, {HISTORY_UNTIL}, 3600)) AS hour FROM fx_order_history")
view("fx_book_all", """SELECT hour, chain_id, pool_id, side, price, cast(sum(rem) AS bigint) AS quantity, count(*) AS order_count
  FROM fx_all_hours g JOIN fx_order_hours o ON o.ts < hour + 3600 AND o.until >= hour + 3600
  WHERE rem > 0 GROUP BY 1, 2, 3, 4, 5""")
query("book_history_hourly", "SELECT * FROM fx_book_all")(
    lambda fx: books.book_history_all(fx.orders, fx.order_history, HISTORY_UNTIL))

# --- candles -------------------------------------------------------------------------------------
_INTERVALS = "(VALUES ('1m', 60), ('5m', 300), ('30m', 1800), ('1h', 3600), ('1d', 86400)) i(interval, step)"
view("fx_klines", f"""SELECT chain_id, symbol, interval, ts - ts % step AS open_time, ts - ts % step + step - 1 AS close_time,
  min_by(price, seq) AS open, max(price) AS high, min(price) AS low, max_by(price, seq) AS close, round(avg(price) + 1e-9, 4) AS average,
  round(sum(quantity), 2) AS volume, round(sum(quote_qty), 2) AS quote_volume, count(*) AS trade_count,
  round(sum(CASE WHEN is_buyer THEN quantity ELSE 0.0 END), 2) AS taker_buy_base_volume,
  round(sum(CASE WHEN is_buyer THEN quote_qty ELSE 0.0 END), 2) AS taker_buy_quote_volume
  FROM fx_trades, {_INTERVALS} GROUP BY chain_id, symbol, interval, step, ts - ts % step""")


def rounded_klines(df):
    for c in ("volume", "quote_volume", "taker_buy_base_volume", "taker_buy_quote_volume"):
        df = df.withColumn(c, r(c, 2))
    return df.withColumn("average", nudged("average", 4))


_klines = lambda fx, iv=None: rounded_klines(trades.klines(fx.trades, iv))
query("klines", "SELECT * FROM fx_klines")(_klines)
query("klines_1h", "SELECT * FROM fx_klines WHERE interval = '1h'")(lambda fx: _klines(fx, {"1h": 3600}))
query("kline_query", f"""SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, symbol ORDER BY open_time) AS rn FROM fx_klines
  WHERE interval = '1h' AND open_time BETWEEN {AS_OF - 720 * 3600} AND {AS_OF}) WHERE rn <= 500""")(
    lambda fx: trades.kline_query(_klines(fx, {"1h": 3600}), "1h", AS_OF - 720 * 3600, AS_OF, 500))
query("kline_query_last", f"""SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, symbol ORDER BY open_time DESC) AS rn FROM fx_klines
  WHERE interval = '5m' AND open_time BETWEEN 0 AND {AS_OF}) WHERE rn <= 1000""")(
    lambda fx: trades.kline_query(_klines(fx, {"5m": 300}), "5m", 0, AS_OF, 1000, last=True))
_f = lambda c: f"format('{{:.2f}}', {c}) AS {c}"
query("kline_tuple", f"""SELECT chain_id, symbol, interval, open_time * 1000 AS open_time_ms, {_f('open')}, {_f('high')}, {_f('low')}, {_f('close')},
  {_f('volume')}, close_time * 1000 AS close_time_ms, {_f('quote_volume')}, trade_count, {_f('taker_buy_base_volume')},
  {_f('taker_buy_quote_volume')}, '0' AS ignored FROM fx_klines WHERE interval = '1h'""")(
    lambda fx: trades.kline_tuple(_klines(fx, {"1h": 3600})))
