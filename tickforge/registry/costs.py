"""Slippage and capital-flow queries."""

from pyspark.sql import functions as F

from tickforge.fixtures import AS_OF
from tickforge.functions.columns import r
from tickforge.plans import flows, ledger, slippage
from tickforge.registry.core import query, r2, r4, rounded, view

M0 = AS_OF - 720 * 3600
TOL, RADIUS = 1800, 1800  # the test trades are minutes apart, so the windows are wider than in production
_MONTH = f"ts BETWEEN {M0} AND {AS_OF}"

view("fx_snap_last", """SELECT symbol, ts, arg_max(best_bid, seq) AS best_bid, arg_max(best_ask, seq) AS best_ask FROM fx_book_snapshots GROUP BY 1, 2""")
view("fx_mid", f"""SELECT t.*, CASE WHEN t.ts - s.ts <= {TOL} THEN s.ts END AS matched_ts, CASE WHEN t.ts - s.ts <= {TOL} THEN (s.best_bid + s.best_ask) / 2 END AS mid_price
  FROM fx_trades t ASOF LEFT JOIN fx_snap_last s ON s.symbol = t.symbol AND t.ts >= s.ts""")
query("mid_price_asof", "SELECT trade_id, symbol, ts, price, matched_ts, round(mid_price, 6) AS mid_price FROM fx_mid")(
    lambda fx: slippage.mid_price_asof(fx.trades, fx.book_snapshots, TOL).select(
        "trade_id", "symbol", "ts", "price", "matched_ts", r("mid_price", 6).alias("mid_price")))
view("fx_win", f"""SELECT *, avg(price) OVER (PARTITION BY symbol ORDER BY ts RANGE BETWEEN {RADIUS} PRECEDING AND {RADIUS} FOLLOWING) AS mid_price FROM fx_trades WHERE {_MONTH}""")
query("mid_price_window", f"SELECT trade_id, symbol, ts, price, {r4('mid_price')} FROM fx_win")(
    lambda fx: rounded(slippage.mid_price_window(fx.trades.filter(F.col("ts").between(M0, AS_OF)), RADIUS).select(
        "trade_id", "symbol", "ts", "price", "mid_price"), four="mid_price"))

_CLASS = "CASE WHEN quote_qty < 1000 THEN 'small' WHEN quote_qty < 10000 THEN 'medium' WHEN quote_qty < 100000 THEN 'large' ELSE 'whale' END"
view("fx_bps", f"""SELECT *, ts - ts % 3600 + 3600 AS time_bucket, {_CLASS} AS trade_size_category,
  round(CASE WHEN mid_price > 0 THEN abs((price - mid_price) / mid_price * 10000) ELSE 0 END, 6) AS bps FROM fx_mid""")
view("fx_slip", f"""SELECT symbol, time_bucket, trade_size_category, {r4('avg(bps)', 'avg_slippage_bps')}, {r4('max(bps)', 'max_slippage_bps')}, {r4('min(bps)', 'min_slippage_bps')},
  {r4('median(bps)', 'median_slippage_bps')}, count(*) AS trades_count, {r2('sum(quote_qty)', 'total_volume')}, {r4('avg(quote_qty)', 'avg_trade_size')},
  round(CASE WHEN stddev_pop(quote_qty) > 1e-6 AND stddev_pop(bps) > 1e-6 THEN covar_pop(quote_qty, bps) / (stddev_pop(quote_qty) * stddev_pop(bps)) END, 6) AS price_impact_correlation
  FROM fx_bps GROUP BY 1, 2, 3 HAVING count(*) >= 3""")


def _slip(fx):
    return rounded(slippage.slippage_hourly(fx.trades, fx.book_snapshots, TOL), "total_volume",
                   "avg_slippage_bps max_slippage_bps min_slippage_bps median_slippage_bps avg_trade_size").withColumn(
        "price_impact_correlation", r("price_impact_correlation", 6))


query("slippage_hourly", "SELECT * FROM fx_slip")(_slip)
query("slippage_latest", """SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY symbol, trade_size_category ORDER BY time_bucket DESC) AS rn FROM fx_slip) WHERE rn = 1""")(
    lambda fx: slippage.slippage_latest(_slip(fx)))
query("slippage_trends", f"""SELECT symbol, time_bucket, trade_size_category, avg_slippage_bps, trades_count, CASE WHEN prev IS NULL THEN 'neutral'
  WHEN avg_slippage_bps > prev * 1.1 THEN 'increasing' WHEN avg_slippage_bps < prev * 0.9 THEN 'decreasing' ELSE 'stable' END AS trend_direction FROM (
  SELECT *, lag(avg_slippage_bps) OVER (PARTITION BY symbol, trade_size_category ORDER BY time_bucket) AS prev FROM fx_slip WHERE time_bucket BETWEEN {M0} AND {AS_OF})""")(
    lambda fx: slippage.slippage_trends(_slip(fx), 720, AS_OF))
query("slippage_list", f"SELECT * FROM fx_slip WHERE time_bucket BETWEEN {M0} AND {AS_OF} ORDER BY time_bucket DESC, symbol, trade_size_category LIMIT 100")(
    lambda fx: slippage.slippage_list(_slip(fx), 720, AS_OF))

view("fx_pct", "SELECT *, round(abs(price - mid_price) / mid_price * 100, 6) AS slip FROM fx_win")
_QUAL = "CASE WHEN avg(slip) < 0.1 THEN 'excellent' WHEN avg(slip) < 0.5 THEN 'good' WHEN avg(slip) < 1.0 THEN 'fair' ELSE 'poor' END AS slippage_quality"
_SCORE = "CASE WHEN avg(slip) < 0.2 THEN 95 WHEN avg(slip) < 0.5 THEN 85 WHEN avg(slip) < 1.0 THEN 70 ELSE 50 END AS liquidity_score"
_CORE = f"""{r4('avg(slip)', 'avg_slippage')}, {r4('median(slip)', 'median_slippage')}, {r4('max(slip)', 'max_slippage')}, {{sd}}, count(*) AS trade_count,
  count(*) FILTER (WHERE slip > 1.0) AS impacted_trades, {r4('count(*) FILTER (WHERE slip > 1.0) / count(*) * 100', 'impact_rate')}"""
_SD0, _SD = r4("coalesce(stddev_samp(slip), 0)", "slippage_std_dev"), r4("stddev_samp(slip)", "slippage_std_dev")
_Z = lambda c, v="0.0": f"coalesce({c}, {v}) AS {c}"
_SIZES = {"all": "true", "small": "quote_qty < 1000", "medium": "quote_qty >= 1000 AND quote_qty < 10000", "large": "quote_qty >= 10000"}
_SLIP4 = "avg_slippage median_slippage max_slippage slippage_std_dev impact_rate"


def _slippage_series(fx):
    """The series of every trade size."""
    sizes = [None if size == "all" else size for size in _SIZES]
    s = rounded(slippage.slippage_series_by_size(fx.trades, "30d", "hourly", AS_OF, sizes, RADIUS), four=_SLIP4)
    return s.select(F.coalesce("size", F.lit("all")).alias("size"), "timestamp",
                    *[F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(0)).alias(c) for c in s.columns if c not in ("size", "timestamp")])


query("slippage_series", " UNION ALL ".join(f"""SELECT '{_n}' AS size, g.timestamp, {_Z('avg_slippage')}, {_Z('median_slippage')}, {_Z('max_slippage')}, {_Z('slippage_std_dev')}, {_Z('trade_count', 0)},
  {_Z('impacted_trades', 0)}, {_Z('impact_rate')} FROM range({M0}, {AS_OF + 1}, 3600) g(timestamp) LEFT JOIN (SELECT ts - ts % 3600 AS timestamp, {_CORE.format(sd=_SD0)} FROM fx_pct WHERE {_w} GROUP BY 1) s USING (timestamp)"""
    for _n, _w in _SIZES.items()))(_slippage_series)
query("slippage_overall", f"""SELECT {r4('avg(slip)', 'avg_slippage')}, {r4('median(slip)', 'median_slippage')}, {_QUAL},
  {r4('count(*) FILTER (WHERE slip > 1.0) / count(*) * 100', 'impact_rate')}, {_SCORE} FROM (SELECT round(abs(price - m) / m * 100, 6) AS slip FROM fx_trades,
  (SELECT avg(price) AS m FROM fx_trades WHERE {_MONTH}) WHERE {_MONTH})""")(
    lambda fx: rounded(slippage.slippage_overall(fx.trades, "30d", AS_OF), four="avg_slippage median_slippage impact_rate"))
_SYM4 = "avg_slippage median_slippage max_slippage slippage_std_dev impact_rate avg_trade_value"
view("fx_sym_slip", f"""SELECT symbol, ts - ts % 86400 AS timestamp, {_CORE.format(sd=_SD0)}, {r4('avg(quote_qty)', 'avg_trade_value')}, count(*) FILTER (WHERE side = 'Buy') AS buy_trades,
  count(*) FILTER (WHERE side = 'Sell') AS sell_trades, {_QUAL} FROM fx_pct GROUP BY 1, 2""")
_series = lambda fx: rounded(slippage.symbol_slippage_series(fx.trades, "30d", "daily", AS_OF, RADIUS), four=_SYM4)
query("symbol_slippage_series", "SELECT * FROM fx_sym_slip")(_series)
view("fx_sym_sum", f"""SELECT symbol, {_CORE.format(sd=_SD)}, {r4('avg(quote_qty)', 'avg_trade_value')}, {r2('min(quote_qty)', 'min_trade_value')}, {r2('max(quote_qty)', 'max_trade_value')},
  count(*) FILTER (WHERE side = 'Buy') AS buy_trades, count(*) FILTER (WHERE side = 'Sell') AS sell_trades, min(ts) AS first_trade_time, max(ts) AS last_trade_time, {_QUAL}, {_SCORE}
  FROM (SELECT t.*, round(abs(price - m) / m * 100, 6) AS slip FROM fx_trades t JOIN (SELECT symbol, avg(price) AS m FROM fx_trades WHERE {_MONTH} GROUP BY 1) USING (symbol) WHERE {_MONTH}) GROUP BY 1""")
_summary = lambda fx: rounded(slippage.symbol_slippage_summary(fx.trades, "30d", AS_OF), "min_trade_value max_trade_value", _SYM4)
query("symbol_slippage_summary", "SELECT * FROM fx_sym_sum")(_summary)
query("trade_size_filter", "SELECT trade_id, quote_qty FROM fx_trades WHERE quote_qty >= 1000 AND quote_qty < 10000")(
    lambda fx: slippage.trade_size_filter(fx.trades, "medium").select("trade_id", "quote_qty"))
query("slippage_by_symbol_nested", """SELECT symbol, s.avg_slippage, s.trade_count, s.slippage_quality, n AS point_count, first_point, last_point FROM fx_sym_sum s
  JOIN (SELECT symbol, count(*) AS n, min(timestamp) AS first_point, max(timestamp) AS last_point FROM fx_sym_slip GROUP BY 1) USING (symbol)""")(
    lambda fx: slippage.slippage_by_symbol_nested(_series(fx), _summary(fx)).select(
        "symbol", "avg_slippage", "trade_count", "slippage_quality", F.size("points").cast("long").alias("point_count"),
        F.col("points")[0]["timestamp"].alias("first_point"), F.element_at("points", -1)["timestamp"].alias("last_point")))

# --- capital flow --------------------------------------------------------------------------------
INST_V, INST_N = 20000, 5  # the test traders are small; production thresholds are the defaults
view("fx_flow_base", """SELECT t.*, i.period_type, i.step, ts - (ts - i.origin) % i.step + i.step AS time_bucket FROM fx_trades t,
  (VALUES ('1h', 3600, 0), ('4h', 14400, 0), ('1d', 86400, 0), ('1w', 604800, 345600)) i(period_type, step, origin)""")
view("fx_flow_inst", f"""SELECT a.user_id, a.period_type, a.time_bucket, sum(b.v) > {INST_V} AND sum(b.n) > {INST_N} AS inst FROM fx_flow_user a JOIN fx_flow_user b
  ON b.user_id = a.user_id AND b.period_type = a.period_type AND b.time_bucket <= a.time_bucket AND b.time_bucket > a.time_bucket - 7 * a.step GROUP BY 1, 2, 3""")
view("fx_flow_user", "SELECT user_id, period_type, time_bucket, step, sum(quote_qty) AS v, count(*) AS n FROM fx_flow_base GROUP BY 1, 2, 3, 4")
_cs = lambda cond, name: f"sum(CASE WHEN {cond} THEN quote_qty ELSE 0.0 END) AS {name}"
view("fx_flow_sum", f"""SELECT symbol, f.period_type, f.time_bucket, {_cs('is_buyer', 'inflow_volume')}, {_cs('NOT is_buyer', 'outflow_volume')},
  {_cs('is_buyer AND quote_qty > 10000', 'large_inflows')}, {_cs('NOT is_buyer AND quote_qty > 10000', 'large_outflows')},
  {_cs('is_buyer AND quote_qty > 100000', 'whale_inflows')}, {_cs('NOT is_buyer AND quote_qty > 100000', 'whale_outflows')},
  {_cs('is_buyer AND quote_qty < 1000', 'retail_inflows')}, {_cs('NOT is_buyer AND quote_qty < 1000', 'retail_outflows')},
  sum(CASE WHEN inst THEN CASE WHEN is_buyer THEN quote_qty ELSE -quote_qty END ELSE 0.0 END) AS institutional_flow, count(*) AS n, sum(quote_qty) AS v,
  sum(CASE WHEN is_buyer THEN quote_qty ELSE -quote_qty END) AS nf, count(DISTINCT CASE WHEN is_buyer THEN user_id END) AS unique_inflow_addresses,
  count(DISTINCT CASE WHEN NOT is_buyer THEN user_id END) AS unique_outflow_addresses, arg_min(price, (ts, seq, chain_id)) AS o, arg_max(price, (ts, seq, chain_id)) AS c
  FROM fx_flow_base f JOIN fx_flow_inst USING (user_id, period_type, time_bucket) GROUP BY 1, 2, 3""")
_VOLS = "inflow_volume outflow_volume large_inflows large_outflows whale_inflows whale_outflows retail_inflows retail_outflows institutional_flow".split()
view("fx_flow", f"""SELECT symbol, period_type, time_bucket, {r2('nf', 'net_flow')}, {', '.join(r2(c) for c in _VOLS)}, 0.0::double AS dex_flow, {r2('nf', 'cex_flow')}, unique_inflow_addresses,
  unique_outflow_addresses, {r4('greatest(whale_inflows + whale_outflows, large_inflows + large_outflows) / v', 'flow_concentration')}, {r4('n / v * 1000', 'flow_velocity')},
  CASE WHEN o > 0 THEN cast(sign(c - o) * sign(round(nf, 6)) AS double) ELSE 0.0 END AS price_correlation,
  CASE WHEN nf > v * 0.1 THEN 'bullish' WHEN nf < -v * 0.1 THEN 'bearish' ELSE 'neutral' END AS flow_momentum,
  {r4('v / sum(v) OVER (PARTITION BY period_type, time_bucket) * 100', 'dominance_score')}, {r2('institutional_flow + whale_inflows - whale_outflows', 'smart_money_flow')},
  CASE WHEN abs(nf) > v * 0.3 THEN 'strong' WHEN abs(nf) > v * 0.1 THEN 'medium' ELSE 'weak' END AS flow_strength FROM fx_flow_sum WHERE v > 0""")


def _flow(fx, periods=None):
    return rounded(flows.capital_flow(fx.trades, periods, INST_V, INST_N), "net_flow cex_flow smart_money_flow " + " ".join(_VOLS),
                   "flow_concentration flow_velocity dominance_score")


_W = f"time_bucket BETWEEN {M0} AND {AS_OF}"
query("capital_flow", "SELECT * FROM fx_flow")(_flow)
query("capital_flow_summary", f"""SELECT symbol, time_bucket, net_flow, flow_momentum, flow_strength, smart_money_flow, {r2('whale_inflows - whale_outflows', 'whale_net_flow')},
  institutional_flow FROM fx_flow WHERE period_type = '1h' AND time_bucket BETWEEN {AS_OF - 168 * 3600} AND {AS_OF}""")(
    lambda fx: rounded(flows.capital_flow_summary(_flow(fx, {"1h": 3600}), "1h", 168, AS_OF), "whale_net_flow"))
query("top_capital_flow_symbols", f"""SELECT symbol, {r2('sum(net_flow)', 'total_net_flow')}, (SELECT flow_strength FROM fx_flow b WHERE b.symbol = a.symbol AND b.period_type = '4h' AND b.{_W}
   GROUP BY 1 ORDER BY count(*) DESC, flow_strength LIMIT 1) AS avg_flow_strength, {r2('sum(smart_money_flow)', 'smart_money_total')},
  {r4('sum(whale_inflows + whale_outflows) / sum(inflow_volume + outflow_volume) * 100', 'whale_dominance')}, {r4('stddev_samp(net_flow) / avg(abs(net_flow))', 'flow_consistency')}
  FROM fx_flow a WHERE period_type = '4h' AND {_W} GROUP BY symbol ORDER BY abs(sum(net_flow)) DESC LIMIT 20""")(
    lambda fx: rounded(flows.top_capital_flow_symbols(_flow(fx, {"4h": 14400}), "4h", 30, AS_OF), "total_net_flow smart_money_total", "whale_dominance flow_consistency"))
query("capital_flow_alerts", f"""SELECT symbol, time_bucket, net_flow, {r4('abs(net_flow) / typical', 'flow_magnitude')}, CASE WHEN net_flow > 0 THEN 'Unusual Inflow' ELSE 'Unusual Outflow' END AS alert_type,
  smart_money_flow FROM fx_flow JOIN (SELECT symbol, avg(abs(net_flow)) AS typical FROM fx_flow WHERE period_type = '1h' AND time_bucket BETWEEN {AS_OF - 168 * 3600} AND {AS_OF}
  GROUP BY 1 HAVING count(*) >= 10) USING (symbol) WHERE period_type = '1h' AND {_W} AND abs(net_flow) > typical * 3.0""")(
    lambda fx: rounded(flows.capital_flow_alerts(_flow(fx, {"1h": 3600}), "1h", 720, AS_OF), four="flow_magnitude"))
query("capital_flow_list", f"SELECT * FROM fx_flow WHERE period_type = '1d' AND {_W} ORDER BY time_bucket DESC, abs(net_flow) DESC, symbol LIMIT 100")(
    lambda fx: flows.capital_flow_list(_flow(fx, {"1d": 86400}), "1d", 720, AS_OF))

view("fx_inflow", f"""SELECT g.timestamp, coalesce(d, 0) AS deposits, coalesce(v, 0.0) AS tv, coalesce(u, 0) AS unique_depositors FROM range({M0}, {AS_OF + 1}, 3600) g(timestamp)
  LEFT JOIN (SELECT ts - ts % 3600 AS timestamp, cast(sum(d_amount) AS bigint) AS d, count(DISTINCT user_id) AS u FROM fx_moves WHERE d_amount > 0 AND {_MONTH} GROUP BY 1) a USING (timestamp)
  LEFT JOIN (SELECT ts - ts % 3600 AS timestamp, sum(quote_qty) AS v FROM fx_trades WHERE {_MONTH} GROUP BY 1) b USING (timestamp)""")
_HALF = f"{M0} + 3600 * (720 / 2)"
query("inflow_series", f"""SELECT timestamp, {r2('deposits + tv', 'total_inflow')}, deposits, {r2('tv', 'trading_volume')}, deposits - lag(deposits, 1, 0) OVER (ORDER BY timestamp) AS net_flow,
  unique_depositors, {r4('avg(tv) OVER ()', 'avg_inflow')}, {r2('max(tv) OVER ()', 'peak_inflow')}, (SELECT CASE WHEN avg(tv) FILTER (WHERE timestamp >= {_HALF}) > avg(tv) FILTER (WHERE timestamp < {_HALF}) THEN 'positive'
   WHEN avg(tv) FILTER (WHERE timestamp >= {_HALF}) < avg(tv) FILTER (WHERE timestamp < {_HALF}) THEN 'negative' ELSE 'neutral' END FROM fx_inflow) AS trend FROM fx_inflow""")(
    lambda fx: rounded(flows.inflow_series(fx.ledger_events, fx.trades, "30d", "hourly", AS_OF), "total_inflow trading_volume peak_inflow", "avg_inflow"))
_FA = f"""{r2('sum(CASE WHEN is_buyer THEN quote_qty ELSE 0.0 END)', 'total_inflow')}, {r2('sum(CASE WHEN is_buyer THEN 0.0 ELSE quote_qty END)', 'total_outflow')},
  {r2('sum(quote_qty)', 'total_volume')}, {r2('sum(CASE WHEN is_buyer THEN quote_qty ELSE -quote_qty END)', 'net_flow')}, count(*) AS trade_count, count(DISTINCT user_id) AS unique_traders,
  count(*) FILTER (WHERE is_buyer) AS buy_trades, count(*) FILTER (WHERE NOT is_buyer) AS sell_trades, {r4('avg(quote_qty)', 'avg_trade_size')}, {r2('min(quote_qty)', 'min_trade_size')},
  {r2('max(quote_qty)', 'max_trade_size')}"""
_NF = "round(sum(CASE WHEN is_buyer THEN quote_qty ELSE -quote_qty END), 6)"
_dir = lambda k: f"CASE WHEN {_NF} > sum(quote_qty) * {k} THEN 'strong_inflow' WHEN {_NF} > 0 THEN 'inflow' WHEN {_NF} < -sum(quote_qty) * {k} THEN 'strong_outflow' WHEN {_NF} < 0 THEN 'outflow' ELSE 'balanced' END AS flow_direction"
_T2 = "total_inflow total_outflow total_volume net_flow min_trade_size max_trade_size"
query("symbol_flow_series", f"SELECT symbol, ts - ts % 3600 AS timestamp, {_FA}, {_dir(0.1)} FROM fx_trades WHERE {_MONTH} GROUP BY 1, 2")(
    lambda fx: rounded(flows.symbol_flow_series(fx.trades, "30d", "hourly", AS_OF), _T2, "avg_trade_size"))
query("symbol_flow_summary", f"""SELECT symbol, {_FA}, {_dir(0.2)}, min(ts) AS first_trade_time, max(ts) AS last_trade_time, {r4(f'{_NF} / sum(quote_qty) * 100', 'flow_percentage')},
  CASE WHEN count(*) > 1000 THEN 'high' WHEN count(*) > 100 THEN 'medium' ELSE 'low' END AS activity_level,
  {r4('sum(CASE WHEN is_buyer THEN quote_qty ELSE 0.0 END) / count(*) FILTER (WHERE is_buyer)', 'avg_inflow_per_trade')},
  {r4('sum(CASE WHEN is_buyer THEN 0.0 ELSE quote_qty END) / count(*) FILTER (WHERE NOT is_buyer)', 'avg_outflow_per_trade')} FROM fx_trades WHERE {_MONTH} GROUP BY 1""")(
    lambda fx: rounded(flows.symbol_flow_summary(fx.trades, "30d", AS_OF), _T2, "avg_trade_size flow_percentage avg_inflow_per_trade avg_outflow_per_trade"))

for _op, _name in (("deposit", "deposit_inflow"), ("withdraw", "withdrawal_outflow")):
    view(f"fx_mv_{_op}", f"""SELECT l.*, c.symbol, l.amount / pow(10.0, coalesce(c.decimals, 18)) AS h FROM fx_ledger l LEFT JOIN fx_currencies c
      ON lower(c.address) = lower(l.currency) AND c.chain_id = l.chain_id WHERE op = '{_op}' AND {_MONTH}""")
    query(f"{_name}_series", f"SELECT ts - ts % 86400 AS timestamp, {r4('sum(h)', 'total')}, count(*) AS movements, count(DISTINCT user_id) AS unique_users FROM fx_mv_{_op} GROUP BY 1")(
        lambda fx, op=_op: rounded(flows.movement_series(ledger.keyed_log(fx.ledger_events, op), fx.currencies, "30d", "daily", AS_OF), four="total"))
    query(f"{_name}_summary", f"""SELECT {r4('sum(h)', 'total')}, count(*) AS movements, count(DISTINCT user_id) AS unique_users,
      {r4('sum(h) / count(DISTINCT ts - ts % 86400)', 'avg_per_bucket')} FROM fx_mv_{_op}""")(
        lambda fx, op=_op: rounded(flows.movement_summary(ledger.keyed_log(fx.ledger_events, op), fx.currencies, "30d", "daily", AS_OF), four="total avg_per_bucket"))
_REP = """SELECT {t}, count(*) AS movements, count(DISTINCT user_id) AS unique_users, {a}, (SELECT round(max(x) + 1e-9, 4) FROM (SELECT sum(h) AS x FROM {v} GROUP BY ts - ts % 86400)) AS peak_bucket,
  {s}, {x} FROM {v}"""
_rep = lambda v, x: _REP.format(t=r4("sum(h)", "total"), a=r4("sum(h) / count(DISTINCT ts - ts % 86400)", "avg_per_bucket"), s=r4("sum(h) / count(*)", "avg_size"), v=v, x=x)
_R4 = "total avg_per_bucket peak_bucket avg_size"
query("inflow_report", _rep("fx_mv_deposit", """CASE WHEN count(*) > 10 THEN 'positive' WHEN count(*) > 5 THEN 'neutral' ELSE 'negative' END AS trend,
  CASE WHEN sum(h) > 1000000 THEN 'strong' WHEN sum(h) > 100000 THEN 'moderate' ELSE 'early' END AS stage"""))(
    lambda fx: rounded(flows.inflow_report(ledger.keyed_log(fx.ledger_events, "deposit"), fx.currencies, "30d", "daily", AS_OF), four=_R4))
query("outflow_report", _rep("fx_mv_withdraw", """CASE WHEN count(*) > 10 THEN 'declining' WHEN count(*) > 5 THEN 'stable' ELSE 'low' END AS trend,
  CASE WHEN count(*) > 20 THEN 'high' ELSE 'low' END AS risk_level, CASE WHEN count(*) > 20 THEN 'high' WHEN count(*) > 10 THEN 'moderate' WHEN count(*) > 0 THEN 'low' ELSE 'none' END AS activity"""))(
    lambda fx: rounded(flows.outflow_report(ledger.keyed_log(fx.ledger_events, "withdraw"), fx.currencies, "30d", "daily", AS_OF), four=_R4))
