"""Liquidity queries over current and historical books."""

from pyspark.sql import functions as F

from tickforge.fixtures import AS_OF
from tickforge.plans import books, liquidity
from tickforge.plans.orders import ORDER
from tickforge.registry.core import VIEWS, nudged, query, r2, r4, rounded, view
from tickforge.session import scratch_path

H0 = AS_OF - 24 * 3600
M0 = AS_OF - 720 * 3600
_BOOK = f"""{r2("sum(CASE WHEN side = 'Buy' THEN value ELSE 0.0 END)", 'bid_depth')}, {r2("sum(CASE WHEN side = 'Sell' THEN value ELSE 0.0 END)", 'ask_depth')},
  cast(sum(CASE WHEN side = 'Buy' THEN order_count ELSE 0 END) AS bigint) AS bid_orders, cast(sum(CASE WHEN side = 'Sell' THEN order_count ELSE 0 END) AS bigint) AS ask_orders,
  max(CASE WHEN side = 'Buy' THEN h_price END) AS best_bid, min(CASE WHEN side = 'Sell' THEN h_price END) AS best_ask"""
view("fx_levels", "SELECT d.*, p.coin AS symbol, d.price / cast(100 AS double) AS h_price, d.quantity * (d.price / cast(100 AS double)) AS value FROM fx_depth d JOIN fx_pools p ON p.chain_id = d.chain_id AND p.order_book = d.pool_id")
query("liquidity_now", f"""SELECT p.coin AS symbol, p.chain_id, p.order_book AS pool_id, coalesce(bid_depth, 0.0) AS bid_depth, coalesce(ask_depth, 0.0) AS ask_depth, coalesce(bid_orders, 0) AS bid_orders,
  coalesce(ask_orders, 0) AS ask_orders, coalesce(best_bid, 0.0) AS best_bid, best_ask FROM fx_pools p LEFT JOIN (SELECT chain_id, pool_id, {_BOOK} FROM fx_levels
  WHERE last_updated >= {AS_OF - 168 * 3600} AND order_count > 0 GROUP BY 1, 2) b ON b.chain_id = p.chain_id AND b.pool_id = p.order_book""")(
    lambda fx: rounded(liquidity.liquidity_now(fx.pools, fx.depth, "7d", AS_OF), "bid_depth ask_depth"))
query("symbol_liquidity_summary", f"""SELECT symbol, chain_id, pool_id, bid_depth, ask_depth, {r2('bd + ad', 'total_depth')}, bid_orders, ask_orders, best_bid, best_ask,
  {r4('CASE WHEN best_bid > 0 AND best_ask > 0 THEN (best_ask - best_bid) / best_bid * 100 ELSE 0 END', 'spread_percentage')}, coalesce(n, 0) AS recent_trades,
  {r4('coalesce(a, 0)', 'avg_trade_volume')}, f AS first_trade_time, l AS last_trade_time FROM (SELECT chain_id, pool_id, symbol, {_BOOK},
  sum(CASE WHEN side = 'Buy' THEN value ELSE 0.0 END) AS bd, sum(CASE WHEN side = 'Sell' THEN value ELSE 0.0 END) AS ad FROM fx_levels WHERE quantity > 0 GROUP BY 1, 2, 3)
  LEFT JOIN (SELECT chain_id, symbol AS pool_id, count(*) AS n, avg(quote_qty) AS a, min(ts) AS f, max(ts) AS l FROM fx_trades WHERE ts BETWEEN {H0} AND {AS_OF} GROUP BY 1, 2) USING (chain_id, pool_id)""")(
    lambda fx: rounded(liquidity.symbol_liquidity_summary(fx.pools, fx.depth, fx.trades, "24h", AS_OF), "bid_depth ask_depth total_depth", "spread_percentage avg_trade_volume"))

# Hourly books of the last day feed the metric series and the snapshot queries.
view("fx_day_hours", f"""SELECT hour + 3600 AS snapshot_ts, chain_id, pool_id, side, price, cast(sum(rem) AS bigint) AS quantity, count(*) AS order_count
  FROM range({H0}, {AS_OF}, 3600) g(hour) JOIN fx_order_hours o ON o.ts < hour + 3600 AND o.until >= hour + 3600 WHERE rem > 0 GROUP BY 1, 2, 3, 4, 5""")
view("fx_day_levels", "SELECT d.*, p.coin AS symbol, d.price / cast(100 AS double) AS h_price, d.quantity * (d.price / cast(100 AS double)) AS value FROM fx_day_hours d JOIN fx_pools p ON p.chain_id = d.chain_id AND p.order_book = d.pool_id")
_spans = lambda fx: books.book_spans(fx.orders, fx.order_history, H0, AS_OF)
WINDOW = 7200  # two hours, because the test trades are sparse
view("fx_liq_base", f"""SELECT b.chain_id, symbol, b.snapshot_ts, bid_depth, ask_depth, {r2('bd + ad', 'total_depth')}, best_bid, best_ask,
  {r4('CASE WHEN best_bid > 0 AND best_ask > 0 THEN (best_ask - best_bid) / best_bid * 10000 ELSE 0 END', 'spread_bps')}, bid_orders, ask_orders,
  greatest(0.0, least(100.0, CASE WHEN bd + ad > 100000 THEN 90 WHEN bd + ad > 50000 THEN 70 WHEN bd + ad > 10000 THEN 50 ELSE 30 END - coalesce((best_ask - best_bid) / nullif(best_bid, 0) * 1000, 0))) AS score,
  coalesce(n, 0) AS recent_trades, {r4('coalesce(a, 0)', 'avg_trade_volume')} FROM (SELECT snapshot_ts, chain_id, pool_id, symbol, {_BOOK},
  sum(CASE WHEN side = 'Buy' THEN value ELSE 0.0 END) AS bd, sum(CASE WHEN side = 'Sell' THEN value ELSE 0.0 END) AS ad FROM fx_day_levels GROUP BY 1, 2, 3, 4) b
  LEFT JOIN (SELECT g.snapshot_ts, t.chain_id, t.symbol AS pool_id, count(*) AS n, avg(quote_qty) AS a FROM range({H0 + 3600}, {AS_OF + 1}, 3600) g(snapshot_ts) JOIN fx_trades t
   ON t.ts BETWEEN g.snapshot_ts - {WINDOW} AND g.snapshot_ts GROUP BY 1, 2, 3) r ON r.snapshot_ts = b.snapshot_ts AND r.chain_id = b.chain_id AND r.pool_id = b.pool_id""")
view("fx_liq", f"""SELECT * EXCLUDE score, {r4('score', 'liquidity_score')}, CASE WHEN score >= 80 THEN 'Excellent' WHEN score >= 60 THEN 'Good' WHEN score >= 40 THEN 'Moderate'
  WHEN score >= 20 THEN 'Low' ELSE 'Very Low' END AS liquidity_rating FROM fx_liq_base""")
_metrics = lambda fx: rounded(liquidity.liquidity_metrics_of_spans(_spans(fx), fx.pools, fx.trades, 3600, WINDOW), "bid_depth ask_depth total_depth",
                              "spread_bps liquidity_score avg_trade_volume")
# The metrics tables cover the whole span of the data; the queries over 24 hours ask for the last day.
view("fx_all_levels", "SELECT d.*, hour + 3600 AS snapshot_ts, p.coin AS symbol, d.price / cast(100 AS double) AS h_price, d.quantity * (d.price / cast(100 AS double)) AS value FROM fx_book_all d JOIN fx_pools p ON p.chain_id = d.chain_id AND p.order_book = d.pool_id")
view("fx_liq_base_all", VIEWS["fx_liq_base"].replace("fx_day_levels", "fx_all_levels").replace(
    f"range({H0 + 3600}, {AS_OF + 1}, 3600) g(snapshot_ts)", "(SELECT hour + 3600 AS snapshot_ts FROM fx_all_hours) g"))
view("fx_liq_all", VIEWS["fx_liq"].replace("fx_liq_base", "fx_liq_base_all"))
_all = lambda fx: books.book_spans_all(fx.orders, fx.order_history, AS_OF)
_metrics_all = lambda fx: rounded(liquidity.liquidity_metrics_of_spans(_all(fx), fx.pools, fx.trades, 3600, WINDOW), "bid_depth ask_depth total_depth",
                                  "spread_bps liquidity_score avg_trade_volume")
query("liquidity_metrics", "SELECT * FROM fx_liq_all")(_metrics_all)
_AVG = ", ".join(r4(f"avg({c})", f"avg_{c}") for c in ("bid_depth", "ask_depth", "total_depth", "spread_bps", "liquidity_score")) + ", count(*) AS data_points"
_A4 = "avg_bid_depth avg_ask_depth avg_total_depth avg_spread_bps avg_liquidity_score"
query("liquidity_metrics_hourly", f"SELECT chain_id, symbol, snapshot_ts - snapshot_ts % 3600 AS hour, {_AVG} FROM fx_liq_all GROUP BY 1, 2, 3")(
    lambda fx: rounded(liquidity.liquidity_metrics_hourly(_metrics_all(fx)), four=_A4))
query("liquidity_list", f"SELECT * FROM fx_liq WHERE snapshot_ts BETWEEN {H0} AND {AS_OF} ORDER BY symbol, snapshot_ts DESC, chain_id LIMIT 100")(
    lambda fx: liquidity.liquidity_list(_metrics(fx), "24h", AS_OF))
query("liquidity_latest", "SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, symbol ORDER BY snapshot_ts DESC) AS rn FROM fx_liq_all) WHERE rn = 1")(
    lambda fx: liquidity.liquidity_latest(_metrics_all(fx)))
query("liquidity_trends", f"SELECT chain_id, symbol, snapshot_ts - snapshot_ts % 900 AS time_bucket, {_AVG}, max(snapshot_ts) AS latest_time FROM fx_liq WHERE snapshot_ts BETWEEN {H0} AND {AS_OF} GROUP BY 1, 2, 3")(
    lambda fx: rounded(liquidity.liquidity_trends(_metrics(fx), 24, "15m", AS_OF), four=_A4))

view("fx_snap_agg", """SELECT snapshot_ts, chain_id, pool_id, symbol, round(sum(CASE WHEN side = 'Buy' THEN value ELSE 0.0 END) + 1e-9, 2) AS bid_liquidity,
  round(sum(CASE WHEN side = 'Sell' THEN value ELSE 0.0 END) + 1e-9, 2) AS ask_liquidity, round(sum(value) + 1e-9, 2) AS total_liquidity,
  round(CASE WHEN max(CASE WHEN side = 'Buy' THEN h_price END) > 0 AND min(CASE WHEN side = 'Sell' THEN h_price END) > max(CASE WHEN side = 'Buy' THEN h_price END)
   THEN (min(CASE WHEN side = 'Sell' THEN h_price END) - max(CASE WHEN side = 'Buy' THEN h_price END)) / max(CASE WHEN side = 'Buy' THEN h_price END) ELSE 0.0125 END + 1e-9, 6) AS spread
  FROM fx_day_levels GROUP BY 1, 2, 3, 4""")
_agg = lambda fx: rounded(liquidity.value_history_aggregate(_spans(fx), fx.pools), "bid_liquidity ask_liquidity total_liquidity", six="spread")
query("liquidity_over_time", f"""SELECT snapshot_ts, {r2('sum(bid_liquidity)', 'bid_liquidity')}, {r2('sum(ask_liquidity)', 'ask_liquidity')}, {r2('sum(total_liquidity)', 'total_liquidity')},
  count(DISTINCT symbol) AS active_markets, {r4('avg(spread)', 'average_spread')} FROM fx_snap_agg WHERE snapshot_ts BETWEEN {H0} AND {AS_OF} GROUP BY 1""")(
    lambda fx: rounded(liquidity.liquidity_over_time(_agg(fx), "24h", AS_OF), "bid_liquidity ask_liquidity total_liquidity", "average_spread"))
view("fx_snap_latest", f"""SELECT snapshot_ts, {r2('sum(bid_liquidity)', 'bid_liquidity')}, {r2('sum(ask_liquidity)', 'ask_liquidity')}, {r4('avg(spread)', 'spread')} FROM fx_snap_agg
  WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM fx_snap_agg) GROUP BY 1""")
query("liquidity_latest_snapshot", "SELECT * FROM fx_snap_latest")(
    lambda fx: rounded(liquidity.liquidity_latest_snapshot(_agg(fx)), "bid_liquidity ask_liquidity", "spread"))
view("fx_breakdown", "SELECT snapshot_ts, chain_id, symbol, bid_liquidity, ask_liquidity, total_liquidity, spread FROM (SELECT *, row_number() OVER (PARTITION BY chain_id, symbol ORDER BY snapshot_ts DESC) AS rn FROM fx_snap_agg) WHERE rn = 1")
query("liquidity_breakdown", "SELECT * FROM fx_breakdown")(
    lambda fx: liquidity.liquidity_breakdown(_agg(fx), "24h", AS_OF).select("snapshot_ts", "chain_id", "symbol", "bid_liquidity", "ask_liquidity", "total_liquidity", "spread"))
query("liquidity_report", f"""SELECT {r2('bid_liquidity')}, {r2('ask_liquidity')}, {r2('bid_liquidity + ask_liquidity', 'total_liquidity')}, {r4('sp * 100', 'average_spread_percent')},
  CASE WHEN bid_liquidity + ask_liquidity > 10000 THEN 92.3 WHEN bid_liquidity + ask_liquidity > 5000 THEN 85.7 WHEN bid_liquidity + ask_liquidity > 1000 THEN 78.5 ELSE 65.2 END::double AS liquidity_score,
  CASE WHEN bid_liquidity + ask_liquidity > 10000 THEN 'Excellent' WHEN bid_liquidity + ask_liquidity > 5000 THEN 'Very Good' WHEN bid_liquidity + ask_liquidity > 1000 THEN 'Good' ELSE 'Fair' END AS liquidity_rating,
  active_markets, deep, moderate_depth, shallow, tight, moderate_spread, wide,
  (SELECT array_to_string(list_sort(list(symbol)), ',') FROM (SELECT symbol FROM fx_breakdown ORDER BY total_liquidity DESC, symbol, chain_id LIMIT 3)) AS most_liquid,
  (SELECT array_to_string(list_sort(list(symbol)), ',') FROM (SELECT symbol FROM fx_breakdown WHERE spread < 1 ORDER BY spread, symbol, chain_id LIMIT 3)) AS tightest_spreads
  FROM (SELECT sum(bid_liquidity) AS bid_liquidity, sum(ask_liquidity) AS ask_liquidity, avg(spread) AS sp FROM fx_snap_agg WHERE snapshot_ts = (SELECT max(snapshot_ts) FROM fx_snap_agg)),
  (SELECT count(*) AS active_markets, count(*) FILTER (WHERE total_liquidity > 2000) AS deep, count(*) FILTER (WHERE total_liquidity > 500 AND total_liquidity <= 2000) AS moderate_depth,
   count(*) FILTER (WHERE total_liquidity <= 500) AS shallow, count(*) FILTER (WHERE spread < 0.005) AS tight, count(*) FILTER (WHERE spread BETWEEN 0.005 AND 0.02) AS moderate_spread,
   count(*) FILTER (WHERE spread > 0.02) AS wide FROM fx_breakdown)""")(
    lambda fx: rounded(liquidity.liquidity_report(_agg(fx), "24h", AS_OF), "bid_liquidity ask_liquidity total_liquidity", "average_spread_percent")
    .withColumn("most_liquid", F.array_join("most_liquid", ",")).withColumn("tightest_spreads", F.array_join("tightest_spreads", ",")))


def _stored(fx, df, name):
    """Written once, because several steps read it."""
    path = scratch_path(fx.spark, name)
    df.write.parquet(path)
    return fx.spark.read.parquet(path)


@query("book_history_resume", f"SELECT * FROM fx_book_all WHERE hour >= (SELECT min(hour) + ({AS_OF} - min(hour)) // 7200 * 3600 FROM fx_all_hours)")
def book_history_resume(fx):
    """The second half of the whole span, continued from the spans of the first half as they were stored."""
    history, orders = _stored(fx, fx.order_history.drop("tx_hash"), "order-history"), _stored(fx, fx.orders.select(*ORDER, "side", "price", "quantity"), "orders")
    first = books.first_hour(history)
    middle = AS_OF if first is None else first + (AS_OF - first) // 7200 * 3600
    return books.book_history_resume(orders, history, _stored(fx, books.book_spans_all(orders, history, middle), "book-spans"), AS_OF)
