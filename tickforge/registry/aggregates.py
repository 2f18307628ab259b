"""Volume, trade-count and multi-interval volume queries."""

from pyspark.sql import functions as F

from tickforge.fixtures import AS_OF
from tickforge.plans import volume, volume_etl
from tickforge.registry.core import query, r2, r4, rounded, view


def since(hours):
    return f"ts BETWEEN {AS_OF - hours * 3600} AND {AS_OF}"


DAY, WEEK, MONTH = since(24), since(168), since(720)
_week = lambda c: f"{c} - ({c} - 345600) % 604800"

query("period_window", " UNION ALL ".join(
    f"SELECT '{p}' AS period, cast({0 if h is None else AS_OF - h * 3600} AS bigint) AS start, count(*) FILTER (WHERE ts >= {0 if h is None else AS_OF - h * 3600} AND ts <= {AS_OF}) AS trades FROM fx_trades"
    for p, h in {"1h": 1, "24h": 24, "7d": 168, "30d": 720, "90d": 2160, "1y": 8760, "all": None}.items()))(
    lambda fx: volume.period_counts(fx.trades, AS_OF))
query("trades_summary", f"""SELECT count(*) AS total_trades, {r2('coalesce(sum(quote_qty), 0)', 'total_volume')}, count(DISTINCT user_id) AS unique_traders
  FROM fx_trades WHERE {MONTH}""")(lambda fx: rounded(volume.trades_summary(fx.trades, "30d", AS_OF), "total_volume"))
_SERIES = """SELECT {b} AS timestamp, count(*) AS trade_count, {v}, {a}, count(DISTINCT user_id) AS unique_traders FROM fx_trades WHERE {w} GROUP BY 1"""
for _key, _period, _interval, _b in (("trades_count_series", "30d", "daily", "ts - ts % 86400"),
                                     ("trades_count_series_weekly", "30d", "weekly", _week("ts"))):
    query(_key, _SERIES.format(b=_b, v=r2("sum(quote_qty)", "volume"), a=r4("avg(quote_qty)", "avg_trade_size"), w=MONTH))(
        lambda fx, p=_period, i=_interval: rounded(volume.trades_count_series(fx.trades, p, i, AS_OF), "volume", "avg_trade_size"))
query("symbol_stats", f"""SELECT symbol, symbol || '/usd' AS coin, {r2('sum(quote_qty)', 'total_volume')}, count(*) AS total_trades,
  count(DISTINCT user_id) AS unique_traders, min(price) AS low_price, max(price) AS high_price, {r4('avg(price)', 'avg_price')}
  FROM fx_trades WHERE {MONTH} GROUP BY symbol""")(
    lambda fx: rounded(volume.symbol_stats(fx.pools, fx.trades, "30d", AS_OF), "total_volume", "avg_price"))
_H = AS_OF - 5 * 3600
query("hourly_trading_stats", f"""SELECT symbol, {r2('sum(quote_qty)', 'volume_1h')}, count(*) AS trades_1h, count(DISTINCT user_id) AS unique_traders_1h,
  {r4('avg(price)', 'avg_price_1h')}, min(price) AS low_1h, max(price) AS high_1h, arg_min(price, (ts, seq, chain_id)) AS open_1h, arg_max(price, (ts, seq, chain_id)) AS close_1h
  FROM fx_trades WHERE ts >= {_H} AND ts < {_H + 3600} GROUP BY 1""")(
    lambda fx: rounded(volume.hourly_trading_stats(fx.trades, _H, _H + 3600), "volume_1h", "avg_price_1h"))

_METRICS = f"""{r2('sum(quote_qty)', 'volume')}, count(*) AS trades_count, count(DISTINCT user_id) AS unique_traders, {r4('avg(price)', 'avg_price')},
  max(price) AS high_price, min(price) AS low_price, arg_min(price, (ts, seq, chain_id)) AS open_price, arg_max(price, (ts, seq, chain_id)) AS close_price"""
for _name, _step in (("hourly", 3600), ("daily", 86400)):
    view(f"fx_metrics_{_name}", f"SELECT ts - ts % {_step} AS bucket, symbol, {_METRICS} FROM fx_trades GROUP BY 1, 2")
    query(f"trading_metrics_{_name}", f"SELECT * FROM fx_metrics_{_name}")(
        lambda fx, i=_name: rounded(volume.trading_metrics(fx.trades, i), "volume", "avg_price"))
    query(f"volume_by_pool_{'1h' if _step == 3600 else '1d'}", f"""SELECT ts - ts % {_step} AS bucket, pool_id, count(*) AS trade_count, {r2('sum(quote_qty)', 'volume')},
      {r4('avg(quote_qty)', 'avg_trade_size')}, min(price) AS min_price, max(price) AS max_price, arg_min(price, (ts, seq, chain_id)) AS open_price, arg_max(price, (ts, seq, chain_id)) AS close_price
      FROM fx_trades GROUP BY 1, 2""")(lambda fx, i=_name: rounded(volume.volume_by_pool(fx.trades, i), "volume", "avg_trade_size"))
_hourly = lambda fx: rounded(volume.trading_metrics(fx.trades, "hourly"), "volume", "avg_price")
_daily = lambda fx: rounded(volume.trading_metrics(fx.trades, "daily"), "volume", "avg_price")
query("price_history", f"""SELECT symbol, bucket, open_price, high_price, low_price, close_price, volume FROM fx_metrics_hourly
  WHERE bucket BETWEEN {AS_OF - 168 * 3600} AND {AS_OF}""")(lambda fx: volume.price_history(_hourly(fx), 168, AS_OF))
query("symbol_volume_1h", f"""SELECT ts - ts % 3600 AS bucket, symbol, count(*) AS trade_count, {r2('sum(quote_qty)', 'volume')}, {r4('avg(quote_qty)', 'avg_trade_size')},
  count(DISTINCT user_id) AS unique_traders, {r2("sum(CASE WHEN side = 'Buy' THEN quote_qty ELSE 0.0 END)", 'buy_volume')},
  {r2("sum(CASE WHEN side = 'Sell' THEN quote_qty ELSE 0.0 END)", 'sell_volume')} FROM fx_enriched GROUP BY 1, 2""")(
    lambda fx: rounded(volume.symbol_volume(fx.trades_enriched), "volume buy_volume sell_volume", "avg_trade_size"))
query("unique_traders_1h", """SELECT ts - ts % 3600 AS bucket, count(DISTINCT user_id) AS unique_traders,
  count(DISTINCT CASE WHEN side = 'Buy' THEN user_id END) AS unique_buyers, count(DISTINCT CASE WHEN side = 'Sell' THEN user_id END) AS unique_sellers,
  count(*) AS total_trades FROM fx_enriched GROUP BY 1""")(lambda fx: volume.unique_traders_hourly(fx.trades_enriched))
query("trading_metrics_24h", f"""SELECT {r2('sum(quote_qty)', 'total_volume')}, count(*) AS total_trades, count(DISTINCT user_id) AS unique_traders
  FROM fx_trades WHERE {DAY}""")(lambda fx: rounded(volume.trading_metrics_24h(fx.trades, AS_OF), "total_volume"))
_S24 = f"""SELECT symbol, {r2('sum(quote_qty)', 'volume_24h')}, count(*) AS trades_24h, count(DISTINCT user_id) AS unique_traders_24h,
  max(price) AS high_24h, min(price) AS low_24h, {r4('avg(price)', 'avg_price_24h')} FROM fx_trades WHERE {DAY} GROUP BY 1"""
query("symbol_stats_24h", _S24)(lambda fx: rounded(volume.symbol_stats_24h(fx.trades, AS_OF), "volume_24h", "avg_price_24h"))
query("symbol_stats_24h_top", _S24 + " ORDER BY volume_24h DESC, symbol LIMIT 20")(
    lambda fx: rounded(volume.symbol_stats_24h(fx.trades, AS_OF, 20), "volume_24h", "avg_price_24h"))
query("hourly_metrics_lookup", f"SELECT * FROM fx_metrics_hourly WHERE bucket = {_H}")(
    lambda fx: volume.hourly_metrics_lookup(_hourly(fx), _H))
query("trades_count_rollup", f"""SELECT timestamp, trade_count, {r2('volume')}, {r4('avg_trade_size')}, peak_trades, unique_traders FROM
  (SELECT {_week('bucket')} AS timestamp, cast(sum(trades_count) AS bigint) AS trade_count, sum(volume) AS volume, avg(volume / trades_count) AS avg_trade_size,
   max(trades_count) AS peak_trades FROM fx_metrics_daily WHERE bucket BETWEEN {AS_OF - 720 * 3600} AND {AS_OF} GROUP BY 1) a JOIN
  (SELECT {_week('(ts - ts % 86400)')} AS timestamp, count(DISTINCT user_id) AS unique_traders FROM fx_trades
   WHERE ts - ts % 86400 BETWEEN {AS_OF - 720 * 3600} AND {AS_OF} GROUP BY 1) b USING (timestamp)""")(
    lambda fx: rounded(volume.trades_count_rollup(_daily(fx), fx.trades, "30d", "weekly", AS_OF), "volume", "avg_trade_size"))
view("fx_aggregates", f"""SELECT ts - ts % 3600 AS timestamp, symbol, {r2('sum(quote_qty)', 'volume')}, count(*) AS trade_count, {r4('avg(price)', 'avg_price')},
  max(price) AS high_price, min(price) AS low_price FROM fx_trades GROUP BY 1, 2""")
_agg = lambda fx: rounded(volume.trade_aggregates_hourly(fx.trades), "volume", "avg_price")
query("trade_aggregates_hourly", "SELECT * FROM fx_aggregates")(_agg)
for _name, _step in (("hourly", 3600), ("daily", 86400)):
    query(f"trades_rollup_{_name}", f"""SELECT timestamp - timestamp % {_step} AS time_bucket, symbol, {r2('sum(volume)', 'total_volume')},
      cast(sum(trade_count) AS bigint) AS total_trades, {r4('avg(avg_price)', 'avg_of_avg_price')}, max(high_price) AS high_price, min(low_price) AS low_price
      FROM fx_aggregates GROUP BY 1, 2""")(lambda fx, i=_name: rounded(volume.trades_rollup(_agg(fx), i), "total_volume", "avg_of_avg_price"))
query("mv_current_volume", f"""SELECT symbol, count(*) AS trade_count, {r2('sum(quote_qty)', 'total_volume')}, {r4('avg(price)', 'avg_price')}, max(price) AS high_price,
  min(price) AS low_price, count(DISTINCT user_id) AS unique_traders, max(ts) AS last_trade_time FROM fx_trades WHERE {DAY} GROUP BY 1""")(
    lambda fx: rounded(volume.mv_current_volume(fx.trades, AS_OF), "total_volume", "avg_price"))
query("mv_trade_counts_24h", f"""SELECT ts - ts % 3600 AS trade_hour, symbol, count(*) AS trade_count, {r2('sum(quote_qty)', 'volume')},
  count(DISTINCT user_id) AS unique_traders, {r4('avg(price)', 'avg_price')} FROM fx_trades WHERE {DAY} GROUP BY 1, 2""")(
    lambda fx: rounded(volume.mv_trade_counts_24h(fx.trades, AS_OF), "volume", "avg_price"))
query("symbol_volume_series", f"""SELECT symbol, g.timestamp, {r2('sum(quote_qty)', 'volume')}, count(*) AS trades, count(DISTINCT user_id) AS unique_traders,
  {r4('avg(quote_qty)', 'avg_trade_size')} FROM range({AS_OF - 720 * 3600}, {AS_OF + 1}, 3600) g(timestamp)
  JOIN fx_trades t ON t.ts >= g.timestamp AND t.ts < g.timestamp + 3600 AND {MONTH} GROUP BY 1, 2""")(
    lambda fx: rounded(volume.symbol_volume_series(fx.trades, "30d", "hourly", AS_OF), "volume", "avg_trade_size"))
query("symbol_volume_summary", f"""SELECT symbol, {r2('sum(quote_qty)', 'total_volume')}, count(*) AS total_trades, count(DISTINCT user_id) AS unique_traders,
  {r4('avg(quote_qty)', 'avg_trade_size')}, {r2('max(quote_qty)', 'largest_trade')}, min(ts) AS first_trade_time, max(ts) AS last_trade_time
  FROM fx_trades WHERE {MONTH} GROUP BY 1 HAVING sum(quote_qty) > 0""")(
    lambda fx: rounded(volume.symbol_volume_summary(fx.trades, "30d", AS_OF), "total_volume largest_trade", "avg_trade_size"))
query("volume_report", f"""SELECT symbol, {r2('v', 'volume')}, n AS trades, {r4('v / sum(v) OVER () * 100', 'percentage')}, {r2('sum(v) OVER ()', 'total_volume')},
  (SELECT round(avg(x) + 1e-9, 2) FROM (SELECT sum(quote_qty) AS x FROM fx_trades WHERE {MONTH} GROUP BY ts - ts % 86400)) AS avg_volume_per_interval,
  (SELECT round(max(x) + 1e-9, 2) FROM (SELECT sum(quote_qty) AS x FROM fx_trades WHERE {MONTH} GROUP BY ts - ts % 86400)) AS peak_volume,
  count(*) OVER () AS active_symbols FROM (SELECT symbol, sum(quote_qty) AS v, count(*) AS n FROM fx_trades WHERE {MONTH} GROUP BY 1)""")(
    lambda fx: rounded(volume.volume_report(fx.trades, "30d", "daily", AS_OF), "volume total_volume avg_volume_per_interval peak_volume", "percentage"))
query("trades_report", f"""SELECT cast(sum(n) AS bigint) AS total_trades, {r2('sum(v)', 'total_volume')}, cast(floor(sum(n) / count(*)) AS bigint) AS avg_trades_per_bucket,
  max(n) AS peak_trades, arg_max(b, n * 100000000000 - b) AS peak_bucket FROM (SELECT ts - ts % 86400 AS b, count(*) AS n, sum(quote_qty) AS v FROM fx_trades WHERE {MONTH} GROUP BY 1)""")(
    lambda fx: rounded(volume.trades_report(fx.trades, "30d", "daily", AS_OF), "total_volume"))

# --- multi-interval volume series ----------------------------------------------------------------
view("fx_vol_base", """SELECT t.*, i.interval_type, ts - ts % i.step + i.step AS time_bucket FROM fx_trades t,
  (VALUES ('5m', 300), ('15m', 900), ('1h', 3600), ('4h', 14400), ('1d', 86400)) i(interval_type, step)""")
view("fx_vol_stats", """SELECT symbol, interval_type, time_bucket, count(*) AS trades_count, count(DISTINCT user_id) AS unique_traders, sum(quote_qty) AS volume,
  sum(CASE WHEN is_buyer THEN quote_qty ELSE 0.0 END) AS buy_volume, sum(CASE WHEN is_buyer THEN 0.0 ELSE quote_qty END) AS sell_volume,
  count(*) FILTER (WHERE is_buyer) AS buy_trades, count(*) FILTER (WHERE NOT is_buyer) AS sell_trades, sum(quote_qty) / sum(quantity) AS vwap,
  arg_min(price, (ts, seq, chain_id)) AS open_price, max(price) AS high_price, min(price) AS low_price, arg_max(price, (ts, seq, chain_id)) AS close_price, avg(quote_qty) AS mean_size,
  stddev_samp(price) AS sd FROM fx_vol_base GROUP BY 1, 2, 3""")
view("fx_vol_big", """SELECT symbol, interval_type, time_bucket, count(*) FILTER (WHERE quote_qty > mean_size * 3) AS large_trade_count,
  count(*) FILTER (WHERE quote_qty > mean_size * 10) AS whale_trade_count FROM fx_vol_base JOIN fx_vol_stats USING (symbol, interval_type, time_bucket) GROUP BY 1, 2, 3""")
view("fx_volume_ts", f"""SELECT symbol, interval_type, time_bucket, {r2('volume')}, trades_count, unique_traders, {r2('buy_volume')}, {r2('sell_volume')}, buy_trades, sell_trades,
  {r4('vwap', 'volume_weighted_price')}, open_price, high_price, low_price, close_price, {r2('close_price - open_price', 'price_change')},
  {r4('CASE WHEN open_price > 0 THEN (close_price - open_price) / open_price * 100 ELSE 0 END', 'price_change_percent')},
  {r4('coalesce(avg(volume) OVER (w ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING), volume)', 'volume_sma_20')},
  {r4('CASE WHEN lag(volume) OVER w > 0 THEN greatest(0.0, least(100.0, 50 + (volume - lag(volume) OVER w) / lag(volume) OVER w * 50)) ELSE 50 END', 'volume_rsi')},
  CASE WHEN lag(volume, 5) OVER w IS NULL THEN 'neutral' WHEN volume > lag(volume, 5) OVER w * 1.2 THEN 'increasing'
    WHEN volume < lag(volume, 5) OVER w * 0.8 THEN 'decreasing' ELSE 'neutral' END AS volume_trend,
  {r4('coalesce(sd / vwap, 0)', 'volatility')}, large_trade_count, whale_trade_count,
  {r4('volume / sum(volume) OVER (PARTITION BY interval_type, time_bucket) * 100', 'market_dominance')}
  FROM fx_vol_stats JOIN fx_vol_big USING (symbol, interval_type, time_bucket) WINDOW w AS (PARTITION BY symbol, interval_type ORDER BY time_bucket)""")


def volume_series(fx, intervals=None):
    return rounded(volume_etl.volume_timeseries(fx.trades, intervals), "volume buy_volume sell_volume price_change",
                   "volume_weighted_price price_change_percent volume_sma_20 volume_rsi volatility market_dominance")


query("volume_timeseries", "SELECT * FROM fx_volume_ts")(volume_series)
query("volume_metrics", f"""SELECT symbol, time_bucket, volume, trades_count, volume_trend, price_change_percent, market_dominance FROM fx_volume_ts
  WHERE interval_type = '1h' AND time_bucket BETWEEN {AS_OF - 168 * 3600} AND {AS_OF}""")(
    lambda fx: volume_etl.volume_metrics(volume_series(fx, {"1h": 3600}), "1h", 168, AS_OF))
query("top_volume_symbols", f"""SELECT symbol, {r2('sum(volume)', 'total_volume')}, {r2('avg(volume)', 'avg_volume')}, cast(sum(trades_count) AS bigint) AS total_trades,
  {r4('avg(price_change_percent)', 'avg_price_change')}, (SELECT volume_trend FROM fx_volume_ts b WHERE b.symbol = a.symbol AND b.interval_type = '1h'
    AND b.time_bucket BETWEEN {AS_OF - 720 * 3600} AND {AS_OF} GROUP BY volume_trend ORDER BY count(*) DESC, volume_trend LIMIT 1) AS volume_trend
  FROM fx_volume_ts a WHERE interval_type = '1h' AND time_bucket BETWEEN {AS_OF - 720 * 3600} AND {AS_OF} GROUP BY symbol ORDER BY 2 DESC LIMIT 20""")(
    lambda fx: rounded(volume_etl.top_volume_symbols(volume_series(fx, {"1h": 3600}), "1h", 30, AS_OF), "total_volume avg_volume", "avg_price_change"))
query("volume_anomalies", f"""SELECT symbol, time_bucket, volume, volume_sma_20, {r4('volume / volume_sma_20', 'volume_spike_ratio')}, whale_trade_count FROM fx_volume_ts
  WHERE interval_type = '1h' AND time_bucket BETWEEN {AS_OF - 720 * 3600} AND {AS_OF} AND volume_sma_20 > 0 AND volume / volume_sma_20 >= 3.0""")(
    lambda fx: rounded(volume_etl.volume_anomalies(volume_series(fx, {"1h": 3600}), "1h", 720, AS_OF), four="volume_spike_ratio"))
query("volume_list", f"""SELECT * FROM fx_volume_ts WHERE interval_type = '4h' AND time_bucket BETWEEN {AS_OF - 168 * 3600} AND {AS_OF}
  ORDER BY time_bucket DESC, volume DESC, symbol LIMIT 100""")(
    lambda fx: volume_etl.volume_list(volume_series(fx, {"4h": 14400}), "4h", 168, AS_OF))
