"""Market-data queries."""

from pyspark.sql import functions as F

from tickforge.fixtures import AS_OF
from tickforge.functions.columns import r
from tickforge.plans import books, ledger, market, orders, trades
from tickforge.registry.core import nudged, query, view
from tickforge.registry.folds import rounded_klines

query("resolve_symbol", "SELECT * FROM fx_pools")(lambda fx: market.resolve_symbol(fx.pools))
query("recent_trades", """SELECT chain_id, symbol, trade_id, price, quantity, ts AS ts_s, ts * 1000 AS time_ms, side = 'Sell' AS is_buyer_maker, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY chain_id, symbol ORDER BY seq DESC) AS rn FROM fx_trades) WHERE rn <= 100""")(
    lambda fx: market.recent_trades(fx.trades, 100))
query("recent_trades_oldest", """SELECT chain_id, symbol, trade_id, price, quantity, ts AS ts_s, ts * 1000 AS time_ms, side = 'Sell' AS is_buyer_maker, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY chain_id, symbol ORDER BY seq) AS rn FROM fx_trades) WHERE rn <= 100""")(
    lambda fx: market.recent_trades(fx.trades, 100, newest=False))
query("user_trades", """SELECT chain_id, user_id, fill_id, order_id, symbol, side, price, quantity, is_maker, ts, rn FROM (SELECT *, row_number() OVER (
  PARTITION BY user_id ORDER BY ts DESC, seq DESC, chain_id, side) AS rn FROM fx_enriched) WHERE rn <= 100""")(lambda fx: market.user_trades(fx.trades_enriched))

view("fx_human_spread", """SELECT chain_id, pool_id AS symbol, max(price) FILTER (WHERE side = 'Buy') / cast(100 AS double) AS best_bid,
  min(price) FILTER (WHERE side = 'Sell') / cast(100 AS double) AS best_ask FROM fx_depth WHERE quantity > 0 GROUP BY 1, 2""")


@query("ticker_24h_from_buckets", f"""SELECT l.chain_id, l.symbol, round(last_price - coalesce(open, last_price), 2) AS price_change,
  round((last_price - coalesce(open, last_price)) / coalesce(open, last_price) * 100 + 1e-9, 2) AS price_change_percent,
  coalesce(average, 0.0) AS weighted_avg_price, coalesce(open, last_price) AS prev_close_price, last_price, last_qty,
  coalesce(best_bid, 0.0) AS bid_price, coalesce(best_ask, 0.0) AS ask_price, coalesce(open, 0.0) AS open_price, coalesce(high, 0.0) AS high_price,
  coalesce(low, 0.0) AS low_price, coalesce(volume, 0.0) AS volume, coalesce(quote_volume, 0.0) AS quote_volume,
  coalesce(open_time, {AS_OF - 86400}) * 1000 AS open_time_ms, {AS_OF * 1000} AS close_time_ms, last_id, coalesce(trade_count, 0) AS trade_count
  FROM (SELECT chain_id, symbol, arg_max(price, seq) AS last_price, arg_max(quantity, seq) AS last_qty, arg_max(trade_id, seq) AS last_id FROM fx_trades GROUP BY 1, 2) l
  LEFT JOIN (SELECT * FROM fx_klines WHERE interval = '1d' AND open_time >= {AS_OF - 86400}) k USING (chain_id, symbol) LEFT JOIN fx_human_spread USING (chain_id, symbol)""")
def ticker_24h_from_buckets(fx):
    spread = books.current_spread(fx.depth).select(
        "chain_id", F.col("pool_id").alias("symbol"), (F.col("best_bid") / 100.0).alias("best_bid"), (F.col("best_ask") / 100.0).alias("best_ask"))
    daily = rounded_klines(trades.klines(fx.trades, {"1d": 86400}))
    out = market.ticker_24h_from_buckets(daily, fx.trades, spread, AS_OF)
    return out.withColumn("price_change", r("price_change", 2)).withColumn("price_change_percent", nudged("price_change_percent", 2))


query("ticker_24h_from_trades", f"""SELECT p.chain_id, p.order_book AS symbol, coalesce(open, 0.0) AS open, coalesce(high, 0.0) AS high, coalesce(low, 0.0) AS low,
  coalesce(last, 0.0) AS last, round(coalesce(volume, 0.0), 2) AS volume, round(coalesce(qv, 0.0), 2) AS quote_volume, coalesce(n, 0) AS trade_count,
  round(coalesce(last - open, 0.0), 2) AS price_change,
  coalesce(trunc(cast(round((last - open) * 10000, 6) AS decimal(38, 6)) / cast(open AS decimal(20, 6))) / cast(100 AS double), 0.0) AS price_change_percent
  FROM fx_pools p LEFT JOIN (SELECT chain_id, symbol, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS last,
   sum(quantity) AS volume, sum(quote_qty) AS qv, count(*) AS n FROM fx_trades WHERE ts BETWEEN {AS_OF - 86400} AND {AS_OF} GROUP BY 1, 2) t ON t.chain_id = p.chain_id AND t.symbol = p.order_book""")(
    lambda fx: market.ticker_24h_from_trades(fx.pools, fx.trades, AS_OF).withColumn("volume", r("volume", 2))
    .withColumn("quote_volume", r("quote_volume", 2)).withColumn("price_change", r("price_change", 2)))
query("ticker_price", "SELECT chain_id, symbol, arg_max(price, seq) AS price FROM fx_trades GROUP BY 1, 2")(lambda fx: market.ticker_price(fx.pools, fx.trades))

view("fx_orders_view", """SELECT o.chain_id, user_id, coin AS symbol, order_id, side, type, status, price, quantity, filled,
  cast(floor(filled * price / pow(10.0, quote_decimals)) AS bigint) AS cum_quote_qty, placed_at, ts, seq FROM fx_orders o JOIN fx_pools p ON p.chain_id = o.chain_id AND p.order_book = o.pool_id""")
query("orders_by_user", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY placed_at DESC, seq DESC, chain_id) AS rn FROM fx_orders_view) WHERE rn <= 500""")(
    lambda fx: market.orders_by_user(fx.orders, fx.pools).withColumn("cum_quote_qty", F.col("cum_quote_qty").cast("long")))
query("open_orders", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY placed_at DESC, seq DESC, chain_id) AS rn FROM fx_orders_view
  WHERE status IN ('NEW', 'OPEN', 'PARTIALLY_FILLED')) WHERE rn <= 500""")(lambda fx: market.open_orders(fx.orders, fx.pools).withColumn("cum_quote_qty", F.col("cum_quote_qty").cast("long")))


@query("trade_init_bundle", """SELECT 'orders' AS part, count(*) AS records FROM q_orders_by_user UNION ALL SELECT 'open_orders', count(*) FROM q_open_orders
  UNION ALL SELECT 'trades', count(*) FROM q_user_trades UNION ALL SELECT 'balances', count(*) FROM q_account_balances""")
def trade_init_bundle(fx):
    balances = ledger.account_balances(ledger.balance_ledger(fx.ledger_events), fx.currencies)
    parts = market.trade_init_bundle(fx.orders, fx.pools, fx.trades_enriched, balances)
    out = None
    for name, df in parts.items():
        one = df.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("part"), "records")
        out = one if out is None else out.unionByName(one)
    return out


query("pairs", """SELECT replace(coin, '/', '') AS symbol, split_part(coin, '/', 1) AS base, split_part(coin, '/', 2) AS quote, chain_id, order_book AS pool_id,
  base_decimals, quote_decimals FROM fx_pools""")(lambda fx: market.pairs(fx.pools))
query("markets", f"""SELECT replace(p.coin, '/', '') AS symbol, split_part(p.coin, '/', 1) AS base, split_part(p.coin, '/', 2) AS quote, p.chain_id, p.order_book AS pool_id,
  s.price, s.volume, s.volume_in_quote, {AS_OF} - p.timestamp AS age_seconds, coalesce(bq, 0) AS bid_quantity, coalesce(aq, 0) AS ask_quantity, coalesce(bv, 0) AS bid_value
  FROM fx_pools p JOIN q_pool_running_stats s ON s.chain_id = p.chain_id AND s.pool_id = p.order_book LEFT JOIN (SELECT chain_id, pool_id,
   cast(sum(CASE WHEN side = 'Buy' THEN quantity ELSE 0 END) AS bigint) AS bq, cast(sum(CASE WHEN side = 'Sell' THEN quantity ELSE 0 END) AS bigint) AS aq,
   cast(sum(CASE WHEN side = 'Buy' THEN quantity * price ELSE 0 END) AS bigint) AS bv FROM fx_depth GROUP BY 1, 2) d ON d.chain_id = p.chain_id AND d.pool_id = p.order_book""")(
    lambda fx: market.markets(fx.pools, orders.pool_running_stats(fx.pools, fx.fills), fx.depth, AS_OF).withColumn(
        "volume_in_quote", F.col("volume_in_quote").cast("long")))
query("user_order_count", "SELECT user_id, count(*) AS order_count FROM fx_orders GROUP BY 1")(lambda fx: market.user_order_count(fx.orders))

_ADHOC = """SELECT o.pool_id, o.status, count(*) AS n, sum(o.quantity) AS quantity FROM {orders} o JOIN {pools} p ON p.chain_id = o.chain_id AND p.order_book = o.pool_id
  WHERE o.side = 'Buy' GROUP BY o.pool_id, o.status HAVING count(*) > 10"""
query("adhoc_sql", _ADHOC.format(orders="fx_orders", pools="fx_pools").replace("sum(o.quantity)", "cast(sum(o.quantity) AS bigint)"))(
    lambda fx: market.adhoc_sql(fx.spark, {"state_orders": fx.orders, "state_pools": fx.pools},
                                _ADHOC.format(orders="state_orders", pools="state_pools")))
