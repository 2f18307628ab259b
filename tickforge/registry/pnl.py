"""Positions, PnL and leaderboard queries."""

from pyspark.sql import functions as F

from tickforge.fixtures import AS_OF
from tickforge.functions.columns import r
from tickforge.plans import leaderboards as lb
from tickforge.plans import positions as pos
from tickforge.plans import users
from tickforge.registry.core import query, r2, r4, rounded, view

M0, W0, D0 = AS_OF - 720 * 3600, AS_OF - 168 * 3600, AS_OF - 86400

# --- positions -----------------------------------------------------------------------------------
query("trade_user_asof", """SELECT f.fill_id, f.pool_id, f.side, f.ts, o.user_id AS owner FROM fx_fills f ASOF JOIN
  (SELECT chain_id, pool_id, side, placed_at, arg_max(user_id, seq) AS user_id FROM fx_orders GROUP BY 1, 2, 3, 4) o ON o.chain_id = f.chain_id AND o.pool_id = f.pool_id AND o.side = f.side AND f.ts >= o.placed_at""")(
    lambda fx: pos.trade_user_asof(fx.fills, fx.orders).select("fill_id", "pool_id", "side", "ts", "owner"))
view("fx_numbered", "SELECT *, row_number() OVER (PARTITION BY chain_id, user_id, symbol ORDER BY seq) AS rn FROM fx_trades")
view("fx_fold", """SELECT chain_id, user_id, symbol, arg_max(q, rn) AS q, arg_max(c, rn) AS c, arg_max(r, rn) AS r, max(ts) AS updated_at FROM (WITH RECURSIVE f AS (
   SELECT chain_id, user_id, symbol, rn, ts, CASE WHEN is_buyer THEN quantity ELSE -quantity END AS q, CASE WHEN is_buyer THEN quote_qty ELSE -quote_qty END AS c, 0.0::double AS r FROM fx_numbered WHERE rn = 1
   UNION ALL SELECT n.chain_id, n.user_id, n.symbol, n.rn, n.ts, CASE WHEN n.is_buyer THEN q + quantity ELSE q - quantity END,
    CASE WHEN n.is_buyer THEN c + quantity * price WHEN q > 0 AND quantity > q THEN -((quantity - q) * price) WHEN q > 0 THEN c - c / q * quantity ELSE c - quantity * price END,
    CASE WHEN NOT n.is_buyer AND q > 0 THEN r + (price - c / q) * least(quantity, q) ELSE r END
   FROM f JOIN fx_numbered n ON n.chain_id = f.chain_id AND n.user_id = f.user_id AND n.symbol = f.symbol AND n.rn = f.rn + 1) SELECT * FROM f) GROUP BY 1, 2, 3""")
view("fx_pos_folded", f"""SELECT chain_id, user_id, symbol, q AS quantity, {r4('CASE WHEN q <> 0 THEN abs(c / q) ELSE 0 END', 'avg_cost')}, {r2('CASE WHEN q <> 0 THEN c ELSE 0 END', 'total_cost')},
  {r2('r', 'realized_pnl')}, updated_at FROM fx_fold""")


def _show(p):
    return rounded(p.withColumn("total_cost", F.when(F.col("quantity") != 0, F.col("total_cost")).otherwise(0.0)), "total_cost realized_pnl", "avg_cost")


query("positions_fold", "SELECT * FROM fx_pos_folded")(lambda fx: _show(pos.positions_fold(fx.trades)))


@query("positions_incremental", "SELECT * FROM fx_pos_folded")
def positions_incremental(fx):
    """State at mid-month, then the rest applied to it: must equal one full fold."""
    cut = {r["chain_id"]: r["at"] for r in fx.trades.groupBy("chain_id").agg(F.floor((F.min("seq") + F.max("seq")) / 2).alias("at")).collect()}
    read = F.lit(False)
    for chain, at in cut.items():
        read = read | ((F.col("chain_id") == chain) & (F.col("seq") <= at))
    return _show(pos.positions_incremental(fx.trades, pos.positions_fold(fx.trades.filter(read)), cut))


query("mark_to_market", f"""SELECT user_id, symbol, quantity, {r2('CASE WHEN quantity <> 0 THEN (last - avg_cost) * quantity ELSE 0 END', 'unrealized_pnl')} FROM fx_positions
  JOIN (SELECT symbol, arg_max(price, (ts, seq, chain_id)) AS last FROM fx_trades GROUP BY 1) USING (symbol)""")(
    lambda fx: rounded(pos.mark_to_market(fx.positions, pos.latest_prices(fx.trades, ["symbol"])).select("user_id", "symbol", "quantity", "unrealized_pnl"), "unrealized_pnl"))
query("positions_queries", "SELECT user_id, symbol, quantity, avg_cost, realized_pnl, unrealized_pnl, updated_at FROM fx_positions WHERE quantity <> 0 AND symbol = 'click'")(
    lambda fx: pos.positions_query(fx.positions, symbol="click"))
view("fx_hour_activity", f"""SELECT user_id, ts - ts % 3600 AS bucket, count(*) AS trades_count, {r2('sum(quote_qty)', 'volume_traded')} FROM fx_enriched
  WHERE ts >= {M0} AND ts < {AS_OF} AND status IN ('FILLED', 'PARTIALLY_FILLED') GROUP BY 1, 2""")
query("user_hourly_activity", "SELECT * FROM fx_hour_activity")(
    lambda fx: rounded(pos.user_hourly_activity(fx.trades_enriched, M0, AS_OF), "volume_traded"))
SNAP = AS_OF - 3600 - 60
query("pnl_hourly_snapshot", f"""SELECT cast({SNAP - SNAP % 3600} AS bigint) AS bucket, user_id, {r2('r + u', 'total_pnl')}, {r2('r', 'total_realized_pnl')}, {r2('u', 'total_unrealized_pnl')},
  coalesce(trades_count, 0) AS trades_count, coalesce(volume_traded, 0.0) AS volume_traded FROM (SELECT user_id, sum(realized_pnl) AS r, sum(unrealized_pnl) AS u FROM fx_positions
  WHERE quantity <> 0 OR realized_pnl <> 0 OR unrealized_pnl <> 0 GROUP BY 1) LEFT JOIN (SELECT * EXCLUDE bucket FROM fx_hour_activity WHERE bucket = {SNAP - SNAP % 3600}) USING (user_id)""")(
    lambda fx: rounded(pos.pnl_hourly_snapshot(fx.positions, fx.trades_enriched, SNAP), "total_pnl total_realized_pnl total_unrealized_pnl volume_traded"))
view("fx_hnum", f"SELECT *, ts - ts % 3600 AS bucket, row_number() OVER (PARTITION BY chain_id, user_id, symbol, ts - ts % 3600 ORDER BY seq) AS rn, side = 'Buy' AS buys FROM fx_enriched WHERE ts >= {M0} AND ts < {AS_OF} AND status IN ('FILLED', 'PARTIALLY_FILLED')")
view("fx_hfold", """SELECT chain_id, user_id, symbol, bucket, arg_max(q, rn) AS q, arg_max(a, rn) AS a, arg_max(r, rn) AS r FROM (WITH RECURSIVE f AS (
   SELECT chain_id, user_id, symbol, bucket, rn, CASE WHEN buys THEN quantity ELSE -quantity END AS q, price AS a, 0.0::double AS r FROM fx_hnum WHERE rn = 1
   UNION ALL SELECT n.chain_id, n.user_id, n.symbol, n.bucket, n.rn, CASE WHEN n.buys THEN q + quantity ELSE q - quantity END,
    CASE WHEN n.buys THEN CASE WHEN q + quantity > 0 THEN (q * a + quantity * price) / (q + quantity) ELSE price END
      WHEN q > 0 THEN CASE WHEN quantity > q THEN price ELSE a END ELSE (abs(q) * a + quantity * price) / (abs(q) + quantity) END,
    CASE WHEN NOT n.buys AND q > 0 THEN r + (price - a) * least(quantity, q) ELSE r END
   FROM f JOIN fx_hnum n ON n.chain_id = f.chain_id AND n.user_id = f.user_id AND n.symbol = f.symbol AND n.bucket = f.bucket AND n.rn = f.rn + 1) SELECT * FROM f) GROUP BY 1, 2, 3, 4""")
view("fx_hmark", """SELECT e.chain_id, e.symbol, e.bucket, t.price AS mark FROM (SELECT DISTINCT chain_id, symbol, bucket, bucket + 3600 AS at FROM fx_hnum) e
  ASOF LEFT JOIN (SELECT chain_id, symbol, ts, arg_max(price, seq) AS price FROM fx_enriched GROUP BY 1, 2, 3) t ON t.chain_id = e.chain_id AND t.symbol = e.symbol AND e.at >= t.ts""")
_STORED = M0 + 2 * 86400  # user-hours before it are stored already, with other figures
_HOURS = "bucket, user_id, total_realized_pnl, total_unrealized_pnl, trades_count, volume_traded, total_pnl"
query("pnl_backfill_hourly", f"""SELECT {_HOURS} FROM fx_hourly_pnl WHERE bucket < {_STORED} UNION ALL
  SELECT bucket, user_id, {r2('r', 'total_realized_pnl')}, {r2('u', 'total_unrealized_pnl')}, trades_count, volume_traded, {r2('r + u', 'total_pnl')} FROM
  (SELECT bucket, user_id, sum(r) AS r, sum(CASE WHEN q <> 0 AND mark > 0 THEN (mark - a) * q ELSE 0.0 END) AS u FROM fx_hfold LEFT JOIN fx_hmark USING (chain_id, symbol, bucket) GROUP BY 1, 2) JOIN
  (SELECT bucket, user_id, count(*) AS trades_count, round(sum(quote_qty) + 1e-9, 2) AS volume_traded FROM fx_hnum GROUP BY 1, 2) USING (bucket, user_id)
  WHERE (bucket, user_id) NOT IN (SELECT bucket, user_id FROM fx_hourly_pnl WHERE bucket < {_STORED})""")(
    lambda fx: rounded(pos.pnl_backfill_hourly(fx.trades_enriched, M0, AS_OF, stored=fx.hourly_pnl.filter(F.col("bucket") < _STORED).select(_HOURS.split(", "))),
                       "total_realized_pnl total_unrealized_pnl volume_traded total_pnl"))


@query("mark_price_asof", f"""SELECT e.symbol, e.ts, round(coalesce(CASE WHEN e.ts - t.ts <= 3600 THEN t.price END, d.p, 0.0) + 1e-9, 4) AS mark_price FROM (SELECT s.symbol, g.ts FROM (SELECT DISTINCT symbol FROM fx_trades) s, range({M0}, {AS_OF + 1}, 3600) g(ts)) e
  ASOF LEFT JOIN (SELECT symbol, ts, arg_max(price, seq) AS price FROM fx_trades GROUP BY 1, 2) t ON t.symbol = e.symbol AND e.ts >= t.ts
  LEFT JOIN (SELECT pool_id AS symbol, avg(price / cast(100 AS double)) AS p FROM fx_depth WHERE quantity > 0 AND price > 0 GROUP BY 1) d ON d.symbol = e.symbol""")
def mark_price_asof(fx):
    hours = F.explode(F.sequence(F.lit(M0).cast("long"), F.lit(AS_OF).cast("long"), F.lit(3600).cast("long")))
    points = fx.trades.select("symbol").distinct().withColumn("ts", hours)
    return rounded(pos.mark_price_asof(points, fx.trades, pos.depth_mean_price(fx.depth, fx.pools), 3600), four="mark_price")


query("hourly_pnl_metrics_agg", f"""SELECT updated_at - updated_at % 3600 AS bucket, user_id, {r2('sum(realized_pnl)', 'total_realized_pnl')}, {r2('sum(unrealized_pnl)', 'total_unrealized_pnl')},
  {r2('sum(realized_pnl + unrealized_pnl)', 'total_pnl')} FROM fx_positions GROUP BY 1, 2""")(
    lambda fx: rounded(pos.hourly_pnl_metrics_agg(fx.positions), "total_realized_pnl total_unrealized_pnl total_pnl"))
view("fx_pt", "SELECT *, round(realized_pnl + unrealized_pnl, 8) AS t FROM fx_positions")
query("pnl_summary", f"""SELECT count(*) AS total_users, count(*) FILTER (WHERE t > 0) AS total_gainers, count(*) FILTER (WHERE t < 0) AS total_losers, count(*) FILTER (WHERE t = 0) AS break_even_traders,
  {r2('sum(t)', 'total_pnl')}, {r4('avg(t)', 'avg_pnl')}, {r4('count(*) FILTER (WHERE t > 0) / count(*) * 100', 'win_rate')} FROM fx_pt""")(
    lambda fx: rounded(pos.pnl_summary(fx.positions), "total_pnl", "avg_pnl win_rate"))
for _kind, _where, _order in (("gainers", "t > 0", "t DESC"), ("losers", "t < 0", "t ASC"), ("all", "true", "abs(t) DESC")):
    query("pnl_top_performers" + ("" if _kind == "all" else f"_{_kind}"), f"""SELECT user_id, symbol, quantity, realized_pnl, unrealized_pnl, {r2('t', 'total_pnl')}, updated_at FROM fx_pt
      WHERE {_where} ORDER BY {_order}, user_id, symbol LIMIT 100""")(
        lambda fx, k=_kind: rounded(pos.pnl_top_performers(fx.positions, k), "total_pnl"))
query("pnl_series", f"""SELECT bucket - bucket % 86400 AS timestamp, {r2('sum(total_pnl)', 'total_pnl')}, {r2('sum(total_realized_pnl)', 'realized_pnl')}, {r2('sum(total_unrealized_pnl)', 'unrealized_pnl')},
  count(*) FILTER (WHERE total_pnl > 0) AS gainers, count(*) FILTER (WHERE total_pnl < 0) AS losers, {r4('avg(total_pnl)', 'avg_pnl')}, count(DISTINCT user_id) AS active_users
  FROM fx_hourly_pnl WHERE bucket BETWEEN {M0} AND {AS_OF} GROUP BY 1""")(
    lambda fx: rounded(pos.pnl_series(fx.hourly_pnl, "30d", "daily", AS_OF), "total_pnl realized_pnl unrealized_pnl", "avg_pnl"))
query("portfolio_snapshots", f"""SELECT cast({AS_OF} AS bigint) AS snapshot_ts, user_id, {r2('sum(abs(quantity) * avg_cost)', 'total_value')}, count(*) AS position_count
  FROM fx_positions WHERE abs(quantity) > 0.001 GROUP BY 2""")(
    lambda fx: rounded(pos.portfolio_snapshots(fx.positions, AS_OF), "total_value").withColumn(
        "position_count", F.json_array_length("positions").cast("long")).drop("positions"))

# --- leaderboards --------------------------------------------------------------------------------
_activity = lambda fx: rounded(users.daily_user_activity(fx.trades), "total_volume", "total_fees_paid")
_TYPE = lambda c: f"CASE WHEN {c} > 10000 THEN 'whale' WHEN {c} > 1000 THEN 'large_trader' WHEN {c} > 100 THEN 'regular_trader' ELSE 'small_trader' END AS trader_type"
_RANK = lambda c: f"row_number() OVER (ORDER BY round({c}, 6) DESC, user_id) AS rank"
query("pnl_leaderboard", f"""SELECT user_id, {r2('t', 'total_pnl')}, {r2('r', 'realized_pnl')}, {r2('u', 'unrealized_pnl')}, {_RANK('t')} FROM (SELECT user_id, sum(total_pnl) AS t, sum(total_realized_pnl) AS r,
  sum(total_unrealized_pnl) AS u FROM fx_hourly_pnl WHERE bucket BETWEEN {W0} AND {AS_OF} GROUP BY 1) QUALIFY rank <= 100""")(
    lambda fx: rounded(lb.pnl_leaderboard(fx.hourly_pnl, "7d", AS_OF), "total_pnl realized_pnl unrealized_pnl"))
query("volume_leaderboard", f"""SELECT user_id, {r2('v', 'total_volume')}, n AS total_trades, {r4('v / n', 'volume_per_trade')}, {_TYPE('v / n')}, {_RANK('v')} FROM (SELECT user_id, sum(total_volume) AS v,
  cast(sum(trades_count) AS bigint) AS n FROM fx_activity WHERE bucket BETWEEN {W0} AND {AS_OF} GROUP BY 1) QUALIFY rank <= 100""")(
    lambda fx: rounded(lb.volume_leaderboard(_activity(fx), "7d", AS_OF), "total_volume", "volume_per_trade"))
_P2 = "total_pnl realized_pnl unrealized_pnl best_session_pnl worst_session_pnl"
view("fx_lbh", f"""SELECT bucket AS period_bucket, user_id, {r2('sum(total_pnl)', 'total_pnl')}, {r2('sum(total_realized_pnl)', 'realized_pnl')}, {r2('sum(total_unrealized_pnl)', 'unrealized_pnl')},
  count(*) AS trading_sessions, {r4('avg(total_pnl)', 'avg_pnl_per_session')}, max(total_pnl) AS best_session_pnl, min(total_pnl) AS worst_session_pnl FROM fx_hourly_pnl GROUP BY 1, 2""")
_lbh = lambda fx: rounded(lb.pnl_lb_hourly(fx.hourly_pnl), "total_pnl realized_pnl unrealized_pnl", "avg_pnl_per_session")
query("pnl_lb_hourly", "SELECT * FROM fx_lbh")(_lbh)
view("fx_lbd", f"""SELECT period_bucket - period_bucket % 86400 AS daily_bucket, user_id, {r2('sum(total_pnl)', 'daily_total_pnl')}, {r2('sum(realized_pnl)', 'daily_realized_pnl')},
  {r2('sum(unrealized_pnl)', 'daily_unrealized_pnl')}, count(*) AS active_hours, {r4('avg(total_pnl)', 'avg_hourly_pnl')}, max(total_pnl) AS best_hour_pnl, min(total_pnl) AS worst_hour_pnl FROM fx_lbh GROUP BY 1, 2""")
_lbd = lambda fx: rounded(lb.pnl_lb_daily(_lbh(fx)), "daily_total_pnl daily_realized_pnl daily_unrealized_pnl", "avg_hourly_pnl")
query("pnl_lb_daily", "SELECT * FROM fx_lbd")(_lbd)
view("fx_vlbh", f"SELECT ts - ts % 3600 AS period_bucket, user_id, {r2('sum(quote_qty)', 'total_volume')}, count(*) AS total_trades, {r4('avg(quote_qty)', 'avg_trade_size')} FROM fx_trades GROUP BY 1, 2")
_vlbh = lambda fx: rounded(lb.volume_lb_hourly(fx.trades), "total_volume", "avg_trade_size")
query("volume_lb_hourly", "SELECT * FROM fx_vlbh")(_vlbh)
view("fx_vlbd", f"""SELECT period_bucket - period_bucket % 86400 AS daily_bucket, user_id, {r2('sum(total_volume)', 'daily_total_volume')}, cast(sum(total_trades) AS bigint) AS daily_total_trades,
  {r4('avg(avg_trade_size)', 'daily_avg_trade_size')}, count(*) AS daily_active_hours, max(total_volume) AS daily_peak_volume, max(total_trades) AS daily_peak_trades,
  CASE WHEN count(*) >= 16 THEN 'very_active' WHEN count(*) >= 8 THEN 'active' WHEN count(*) >= 4 THEN 'moderate' ELSE 'light' END AS activity_level FROM fx_vlbh GROUP BY 1, 2""")
_vlbd = lambda fx: rounded(lb.volume_lb_daily(_vlbh(fx)), "daily_total_volume", "daily_avg_trade_size")
query("volume_lb_daily", "SELECT * FROM fx_vlbd")(_vlbd)
view("fx_p24", f"""SELECT user_id, {r2('t', 'total_pnl')}, {r2('r', 'realized_pnl')}, {r2('u', 'unrealized_pnl')}, n AS trading_sessions, {r4('a', 'avg_pnl_per_session')},
  CASE WHEN t > 0 THEN 'profitable' WHEN t = 0 THEN 'breakeven' ELSE 'loss' END AS performance_status, CASE WHEN w > t * 2 THEN 'high_risk' WHEN w > t THEN 'medium_risk' ELSE 'low_risk' END AS risk_level, {_RANK('t')}
  FROM (SELECT user_id, round(sum(total_pnl), 8) AS t, sum(realized_pnl) AS r, sum(unrealized_pnl) AS u, count(*) AS n, avg(total_pnl) AS a, abs(min(worst_session_pnl)) AS w FROM fx_lbh
  WHERE period_bucket BETWEEN {D0} AND {AS_OF} GROUP BY 1)""")
_p24 = lambda fx: rounded(lb.pnl_lb_24h(_lbh(fx), AS_OF), "total_pnl realized_pnl unrealized_pnl", "avg_pnl_per_session")
query("pnl_lb_24h", "SELECT * FROM fx_p24")(_p24)
_DAYS = f"""SELECT user_id, sum(daily_total_pnl) AS t, sum(daily_realized_pnl) AS r, sum(daily_unrealized_pnl) AS u, count(*) AS n, avg(daily_total_pnl) AS a, stddev_samp(daily_total_pnl) AS sd,
  max(daily_total_pnl) AS b, min(daily_total_pnl) AS w, cast(sum(active_hours) AS bigint) AS h, avg(active_hours) AS ha FROM fx_lbd WHERE daily_bucket BETWEEN {{d}} AND {AS_OF} GROUP BY 1"""
_DCOLS = f"""user_id, {r2('t', 'total_pnl')}, {r2('r', 'realized_pnl')}, {r2('u', 'unrealized_pnl')}, n AS active_days, {r4('a', 'avg_daily_pnl')}, {r4('sd', 'pnl_volatility')}, b AS best_day, w AS worst_day"""
query("pnl_lb_7d", f"SELECT {_DCOLS}, h AS total_active_hours, {r4('ha', 'avg_hours_per_day')}, {_RANK('t')} FROM ({_DAYS.format(d=W0)})")(
    lambda fx: rounded(lb.pnl_lb_7d(_lbd(fx), AS_OF), "total_pnl realized_pnl unrealized_pnl", "avg_daily_pnl pnl_volatility avg_hours_per_day"))
view("fx_p30", f"""SELECT {_DCOLS}, {r4("n / cast(30 AS double) * 100", 'trading_frequency_pct')}, {r4('CASE WHEN sd > 0 THEN a / sd ELSE 0 END', 'risk_adjusted_return')}, {_RANK('t')} FROM ({_DAYS.format(d=M0)})""")
_p30 = lambda fx: rounded(lb.pnl_lb_30d(_lbd(fx), AS_OF), "total_pnl realized_pnl unrealized_pnl", "avg_daily_pnl pnl_volatility trading_frequency_pct risk_adjusted_return")
query("pnl_lb_30d", "SELECT * FROM fx_p30")(_p30)
view("fx_v24", f"""SELECT user_id, {r2('v', 'total_volume')}, n AS total_trades, {r4('s', 'avg_trade_size')}, h AS active_hours, pv AS peak_volume, pt AS peak_trades, {r4('v / h', 'volume_per_hour')}, {_TYPE('s')}, {_RANK('v')}
  FROM (SELECT user_id, sum(total_volume) AS v, cast(sum(total_trades) AS bigint) AS n, avg(avg_trade_size) AS s, count(*) AS h, max(total_volume) AS pv, max(total_trades) AS pt FROM fx_vlbh
  WHERE period_bucket BETWEEN {D0} AND {AS_OF} GROUP BY 1) WHERE v > 0""")
_v24 = lambda fx: rounded(lb.volume_lb_24h(_vlbh(fx), AS_OF), "total_volume", "avg_trade_size volume_per_hour")
query("volume_lb_24h", "SELECT * FROM fx_v24")(_v24)
_VD = f"""SELECT user_id, sum(daily_total_volume) AS v, cast(sum(daily_total_trades) AS bigint) AS n, avg(daily_avg_trade_size) AS s, count(*) AS d, avg(daily_total_volume) AS a, max(daily_peak_volume) AS pv,
  cast(sum(daily_active_hours) AS bigint) AS h, avg(daily_active_hours) AS ha, stddev_samp(daily_total_volume) AS sd FROM fx_vlbd WHERE daily_bucket BETWEEN {{d}} AND {AS_OF} GROUP BY 1"""
_VC = f"user_id, {r2('v', 'total_volume')}, n AS total_trades, {r4('s', 'avg_trade_size')}, d AS active_days, {r4('a', 'avg_daily_volume')}, pv AS peak_volume, h AS total_active_hours, {_TYPE('s')}, {_RANK('v')}"
query("volume_lb_7d", f"SELECT {_VC}, {r4('ha', 'avg_hours_per_day')} FROM ({_VD.format(d=W0)}) WHERE v > 0")(
    lambda fx: rounded(lb.volume_lb_7d(_vlbd(fx), AS_OF), "total_volume", "avg_trade_size avg_daily_volume avg_hours_per_day"))
view("fx_v30", f"SELECT {_VC}, {r4('d / cast(30 AS double) * 100', 'trading_frequency_pct')}, {r4('sd / nullif(a, 0)', 'volume_consistency')} FROM ({_VD.format(d=M0)}) WHERE v > 0")
_v30 = lambda fx: rounded(lb.volume_lb_30d(_vlbd(fx), AS_OF), "total_volume", "avg_trade_size avg_daily_volume trading_frequency_pct volume_consistency")
query("volume_lb_30d", "SELECT * FROM fx_v30")(_v30)
query("lb_performance_stats", f"""SELECT 'pnl_24h' AS leaderboard_type, count(*) AS total_entries, {r4('avg(total_pnl)', 'avg_value')}, min(total_pnl) AS min_value, max(total_pnl) AS max_value, cast({AS_OF} AS bigint) AS last_updated FROM fx_p24
  UNION ALL SELECT 'volume_24h', count(*), round(avg(total_volume) + 1e-9, 4), min(total_volume), max(total_volume), {AS_OF} FROM fx_v24""")(
    lambda fx: rounded(lb.lb_performance_stats(_p24(fx), _v24(fx), AS_OF), four="avg_value"))
_COV = f"""SELECT '{{n}}' AS table_name, count(*) AS total_records, count(DISTINCT user_id) AS unique_users, min(bucket) AS earliest_data, max(bucket) AS latest_data, ({AS_OF} - min(bucket)) // 86400 AS days_covered,
  CASE WHEN ({AS_OF} - min(bucket)) // 86400 >= 30 THEN '30d_ready' WHEN ({AS_OF} - min(bucket)) // 86400 >= 7 THEN '7d_ready' WHEN ({AS_OF} - min(bucket)) // 86400 >= 1 THEN '24h_ready' ELSE 'not_ready' END AS readiness FROM {{t}}"""
query("lb_data_coverage", _COV.format(n="hourly_pnl_metrics", t="fx_hourly_pnl") + " UNION ALL " + _COV.format(n="daily_user_activity", t="fx_activity"))(
    lambda fx: lb.lb_data_coverage(fx.hourly_pnl, _activity(fx), AS_OF))


@query("lb_readiness", f"""SELECT 'pnl_coverage' AS check_name, CASE WHEN d >= 30 THEN 'PASS' ELSE 'FAIL' END AS status, d || ' days, ' || u || ' users' AS details FROM (SELECT ({AS_OF} - min(bucket)) // 86400 AS d, count(DISTINCT user_id) AS u FROM fx_hourly_pnl)
  UNION ALL SELECT 'volume_30d_board', CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END, count(*) || ' entries' FROM fx_v30
  UNION ALL SELECT 'startup_job', 'PASS', 'completed' UNION ALL SELECT 'required_tables', 'PASS', 'all present'""")
def lb_readiness(fx):
    jobs = fx.trades.agg(F.max("ts").alias("started_at")).select(F.lit("initial_pnl_backfill").alias("job_name"), F.lit("completed").alias("status"), "started_at")
    return lb.lb_readiness(fx.hourly_pnl, _v30(fx), jobs, AS_OF).drop("recommendation")


query("lb_health", f"""SELECT count(*) AS total_records, count(DISTINCT user_id) AS unique_users, ({AS_OF} - min(bucket)) // 86400 AS days_covered, (SELECT count(*) FROM fx_p30) AS pnl_30d_users,
  (SELECT count(*) FROM fx_v30) AS volume_30d_users, CASE WHEN (SELECT count(*) FROM fx_v30) > 0 AND ({AS_OF} - min(bucket)) // 86400 >= 30 THEN 'HEALTHY' WHEN ({AS_OF} - min(bucket)) // 86400 < 30 THEN 'INSUFFICIENT_DATA'
  ELSE 'NEEDS_ATTENTION' END AS overall_health FROM fx_hourly_pnl""")(lambda fx: lb.lb_health(fx.hourly_pnl, _p30(fx), _v30(fx), AS_OF))
query("lb_page", "SELECT *, (SELECT count(*) FROM fx_v30) AS total FROM fx_v30 WHERE rank > 20 AND rank <= 45")(lambda fx: lb.lb_page(_v30(fx), 25, 20))


@query("lb_user_rank", f"SELECT 'volume' AS board, user_id, rank, cast({AS_OF} AS bigint) AS as_of FROM fx_v30 UNION ALL SELECT 'pnl', user_id, rank, {AS_OF} FROM fx_p30")
def lb_user_rank(fx):
    """Two stored generations per board; the newer one answers."""
    snap = lambda df, name: df.select(F.lit(name).alias("board"), "user_id", "rank", F.explode(F.array(
        F.lit(AS_OF).cast("long"), F.lit(D0).cast("long"))).alias("ts")).withColumn("rank", F.when(F.col("ts") == AS_OF, F.col("rank")).otherwise(F.col("rank") + 1))
    return lb.lb_user_rank(snap(_v30(fx), "volume").unionByName(snap(_p30(fx), "pnl")))


query("mv_volume_leaderboard", f"""SELECT user_id, n AS total_trades, {r2('v', 'total_volume')}, s AS symbols_traded, l AS last_trade_time, f AS first_trade_time, {_RANK('v')} FROM (SELECT user_id, count(*) AS n,
  sum(quote_qty) AS v, count(DISTINCT symbol) AS s, max(ts) AS l, min(ts) AS f FROM fx_trades WHERE ts BETWEEN {M0} AND {AS_OF} GROUP BY 1) QUALIFY rank <= 100""")(
    lambda fx: rounded(lb.mv_volume_leaderboard(fx.trades, AS_OF), "total_volume"))
query("mv_pnl_leaderboard", f"""SELECT user_id, n AS total_trades, {r2('v', 'total_volume')}, l AS last_trade_time, row_number() OVER (ORDER BY n DESC, user_id) AS rank FROM (SELECT user_id, count(*) AS n,
  sum(quote_qty) AS v, max(ts) AS l FROM fx_trades WHERE ts BETWEEN {M0} AND {AS_OF} GROUP BY 1) QUALIFY rank <= 100""")(
    lambda fx: rounded(lb.mv_pnl_leaderboard(fx.trades, AS_OF), "total_volume"))
