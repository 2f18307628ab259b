"""User growth, retention and activity queries."""

from pyspark.sql import functions as F

from tickforge.fixtures import AS_OF
from tickforge.plans import users
from tickforge.registry.core import query, r2, r4, rounded, view

M0 = AS_OF - 720 * 3600
W0 = AS_OF - 168 * 3600

view("fx_activity", f"""SELECT ts - ts % 86400 AS bucket, user_id, count(*) AS trades_count, {r2('sum(quote_qty)', 'total_volume')},
  count(DISTINCT symbol) AS symbols_traded, {r4('sum(quote_qty) * 0.002', 'total_fees_paid')} FROM fx_trades GROUP BY 1, 2""")
_activity = lambda fx: rounded(users.daily_user_activity(fx.trades), "total_volume", "total_fees_paid")
query("daily_user_activity", "SELECT * FROM fx_activity")(_activity)
view("fx_new_users", "SELECT first_seen - first_seen % 86400 AS bucket, count(*) AS new_users_count FROM fx_users GROUP BY 1")
query("daily_new_users", "SELECT * FROM fx_new_users")(lambda fx: users.daily_new_users(fx.trades))
query("cumulative_users", f"""SELECT timestamp, new_users, cast(sum(new_users) OVER (ORDER BY timestamp) AS bigint) AS cumulative_users,
  (SELECT count(*) FROM fx_users) AS total_users, (SELECT count(*) FROM fx_users WHERE first_seen BETWEEN {M0} AND {AS_OF}) AS new_users_in_period,
  {r4(f'(SELECT count(*) FROM fx_users WHERE first_seen BETWEEN {M0} AND {AS_OF}) / (SELECT count(*) FROM fx_users) * 100', 'growth_rate')}
  FROM (SELECT first_seen - first_seen % 3600 AS timestamp, count(*) AS new_users FROM fx_users WHERE first_seen BETWEEN {M0} AND {AS_OF} GROUP BY 1)""")(
    lambda fx: rounded(users.cumulative_users(fx.users, "30d", "hourly", AS_OF), four="growth_rate"))
query("cumulative_new_traders", f"""SELECT timestamp, new_users, cumulative_users, {r4('CASE WHEN prev > 0 THEN (cumulative_users - prev) * 100.0 / prev ELSE 0 END', 'growth_rate')}
  FROM (SELECT *, lag(cumulative_users) OVER (ORDER BY timestamp) AS prev FROM (SELECT timestamp, new_users, cast(sum(new_users) OVER (ORDER BY timestamp) AS bigint) AS cumulative_users
   FROM (SELECT g.timestamp, count(u.user_id) AS new_users FROM range({M0}, {AS_OF + 1}, 86400) g(timestamp)
    LEFT JOIN fx_users u ON u.first_seen >= g.timestamp AND u.first_seen < g.timestamp + 86400 AND u.first_seen <= {AS_OF} GROUP BY 1)))""")(
    lambda fx: rounded(users.cumulative_new_traders(fx.trades, "30d", "daily", AS_OF), four="growth_rate"))
query("cumulative_new_users_rollup", f"""SELECT timestamp, new_users, cumulative_users, {r4('CASE WHEN prev > 0 THEN (cumulative_users - prev) * 100.0 / prev ELSE 0 END', 'growth_rate')},
  cast(sum(new_users) OVER () AS bigint) AS new_users_in_period, {r4('avg(new_users) OVER ()', 'avg_daily_growth')},
  {r4('sum(new_users) OVER () / nullif((max(timestamp) OVER () - min(timestamp) OVER ()) / 86400, 0)', 'growth_per_day')}
  FROM (SELECT *, lag(cumulative_users, 1, 0) OVER (ORDER BY timestamp) AS prev FROM (SELECT bucket AS timestamp, new_users_count AS new_users,
   cast(sum(new_users_count) OVER (ORDER BY bucket) AS bigint) AS cumulative_users FROM fx_new_users WHERE bucket BETWEEN {M0} AND {AS_OF}))""")(
    lambda fx: rounded(users.cumulative_new_users_rollup(users.daily_new_users(fx.trades), "30d", AS_OF), four="growth_rate avg_daily_growth growth_per_day"))
query("mv_user_growth", f"""SELECT timestamp, daily_active_users, daily_trades, cast(sum(daily_active_users) OVER (ORDER BY timestamp) AS bigint) AS sum_of_daily_actives,
  (SELECT count(*) FROM fx_users u WHERE u.first_seen < timestamp + 86400) AS cumulative_users FROM (SELECT ts - ts % 86400 AS timestamp,
  count(DISTINCT user_id) AS daily_active_users, count(*) AS daily_trades FROM fx_trades WHERE ts BETWEEN {AS_OF - 2160 * 3600} AND {AS_OF} GROUP BY 1)""")(
    lambda fx: users.mv_user_growth(fx.trades, AS_OF))

query("unique_traders_series", f"""SELECT timestamp, unique_traders, new_traders, returning_traders,
  {r4('CASE WHEN unique_traders > 0 THEN returning_traders / unique_traders * 100 ELSE 0 END', 'retention_rate')} FROM (
  SELECT g.timestamp, count(DISTINCT t.user_id) AS unique_traders, count(DISTINCT CASE WHEN u.first_seen >= g.timestamp THEN t.user_id END) AS new_traders,
   count(DISTINCT CASE WHEN u.first_seen < g.timestamp THEN t.user_id END) AS returning_traders, count(t.trade_id) AS n
  FROM range({M0}, {AS_OF + 1}, 3600) g(timestamp) LEFT JOIN (SELECT *, ts - ts % 3600 AS h FROM fx_trades WHERE ts BETWEEN {M0} AND {AS_OF}) t ON t.h = g.timestamp
  LEFT JOIN fx_users u ON u.user_id = t.user_id GROUP BY 1) WHERE n >= 2 OR n = 0""")(
    lambda fx: rounded(users.unique_traders_series(fx.trades, "30d", "hourly", AS_OF, 2), four="retention_rate"))
query("unique_traders_summary", f"""SELECT count(*) AS total_unique_traders, {r4('avg(days)', 'avg_active_days')},
  {r4('avg(CASE WHEN days > 1 THEN 1.0 ELSE 0.0 END) * 100', 'overall_retention_rate')},
  (SELECT max(c) FROM (SELECT count(DISTINCT user_id) AS c FROM fx_trades WHERE ts BETWEEN {W0} AND {AS_OF} GROUP BY ts - ts % 86400)) AS peak_daily_traders
  FROM (SELECT user_id, count(*) AS n, count(DISTINCT ts - ts % 86400) AS days FROM fx_trades WHERE ts BETWEEN {W0} AND {AS_OF} GROUP BY 1 HAVING count(*) >= 3)""")(
    lambda fx: rounded(users.unique_traders_summary(fx.trades, "7d", AS_OF, 3), four="avg_active_days overall_retention_rate"))
query("unique_traders_lag", f"""SELECT timestamp, unique_traders, new_traders, returning_traders, {r4('returning_traders / unique_traders * 100', 'retention_rate')},
  (SELECT round(avg(c) + 1e-9, 4) FROM fx_lag_days) AS avg_daily_active_traders, (SELECT max(c) FROM fx_lag_days) AS peak_daily_traders FROM (
  SELECT bucket - (bucket - 345600) % 604800 AS timestamp, count(DISTINCT user_id) AS unique_traders,
   count(DISTINCT CASE WHEN before IS NULL THEN user_id END) AS new_traders, count(DISTINCT CASE WHEN before IS NOT NULL THEN user_id END) AS returning_traders
  FROM (SELECT *, lag(bucket) OVER (PARTITION BY user_id ORDER BY bucket) AS before FROM fx_activity WHERE bucket BETWEEN {M0} AND {AS_OF} AND trades_count >= 2) GROUP BY 1)""")(
    lambda fx: rounded(users.unique_traders_lag(_activity(fx), "30d", "weekly", AS_OF, 2), four="retention_rate avg_daily_active_traders"))
view("fx_lag_days", f"SELECT bucket, count(DISTINCT user_id) AS c FROM fx_activity WHERE bucket BETWEEN {M0} AND {AS_OF} AND trades_count >= 2 GROUP BY 1")

view("fx_symbol_first", "SELECT symbol, user_id, min(ts) AS first_seen FROM fx_trades GROUP BY 1, 2")
query("symbol_unique_traders_series", f"""SELECT symbol, timestamp, unique_traders, new_traders, returning_traders, total_trades, {r2('total_volume')},
  {r4('CASE WHEN unique_traders > 0 THEN returning_traders / unique_traders * 100 ELSE 0 END', 'retention_rate')} FROM (
  SELECT s.symbol, g.timestamp, count(DISTINCT t.user_id) AS unique_traders, count(DISTINCT CASE WHEN f.first_seen >= g.timestamp THEN t.user_id END) AS new_traders,
   count(DISTINCT CASE WHEN f.first_seen < g.timestamp THEN t.user_id END) AS returning_traders, count(t.trade_id) AS total_trades, coalesce(sum(t.quote_qty), 0.0) AS total_volume
  FROM (SELECT DISTINCT symbol FROM fx_trades) s CROSS JOIN range({M0}, {AS_OF + 1}, 3600) g(timestamp)
  LEFT JOIN (SELECT *, ts - ts % 3600 AS h FROM fx_trades WHERE ts BETWEEN {M0} AND {AS_OF}) t ON t.symbol = s.symbol AND t.h = g.timestamp
  LEFT JOIN fx_symbol_first f ON f.symbol = t.symbol AND f.user_id = t.user_id GROUP BY 1, 2)""")(
    lambda fx: rounded(users.symbol_unique_traders_series(fx.trades, "30d", "hourly", AS_OF, min_trades=0), "total_volume", "retention_rate"))
query("symbol_unique_traders_summary", f"""SELECT symbol, count(*) AS unique_traders, count(*) FILTER (WHERE first_seen >= {W0}) AS new_traders,
  count(*) FILTER (WHERE first_seen < {W0}) AS returning_traders, {r4('avg(days)', 'avg_active_days')}, {r4('avg(n)', 'avg_trades_per_trader')},
  {r2('sum(v)', 'total_volume')}, {r4('avg(v)', 'avg_volume_per_trader')}, min(a) AS first_trade_time, max(z) AS last_trade_time,
  CASE WHEN count(*) >= 100 THEN 'very_high' WHEN count(*) >= 50 THEN 'high' WHEN count(*) >= 20 THEN 'medium' WHEN count(*) >= 5 THEN 'low' ELSE 'very_low' END AS activity_level,
  {r4(f'count(*) FILTER (WHERE first_seen < {W0}) / count(*) * 100', 'retention_rate')} FROM (SELECT symbol, user_id, count(*) AS n,
  count(DISTINCT ts - ts % 86400) AS days, sum(quote_qty) AS v, min(ts) AS a, max(ts) AS z FROM fx_trades WHERE ts BETWEEN {W0} AND {AS_OF} GROUP BY 1, 2 HAVING count(*) >= 2)
  JOIN fx_symbol_first USING (symbol, user_id) GROUP BY 1""")(
    lambda fx: rounded(users.symbol_unique_traders_summary(fx.trades, "7d", AS_OF, min_trades=2), "total_volume",
                       "avg_active_days avg_trades_per_trader avg_volume_per_trader retention_rate"))
query("top_users_by_trades", f"""SELECT user_id, cast(sum(trades_count) AS bigint) AS trade_count, {r2('sum(total_volume)', 'total_volume')},
  count(DISTINCT bucket) AS active_days, max(bucket) AS last_trade_day, (SELECT count(DISTINCT user_id) FROM fx_activity WHERE bucket BETWEEN {M0} AND {AS_OF}) AS total
  FROM fx_activity WHERE bucket BETWEEN {M0} AND {AS_OF} GROUP BY 1 ORDER BY trade_count DESC, user_id LIMIT 50 OFFSET 10""")(
    lambda fx: rounded(users.top_users_by_trades(_activity(fx), "30d", AS_OF, 50, 10), "total_volume"))

# --- activity ETL --------------------------------------------------------------------------------
_WON = "(price - mean_price) * CASE WHEN is_buyer THEN 1 ELSE -1 END > 0"
_GAIN = "abs((price - mean_price) * quantity)"
view("fx_ua_base", f"""SELECT user_id, hour, count(*) AS trades_count, sum(quote_qty) AS total_volume, avg(quote_qty) AS avg_trade_size, max(quote_qty) AS largest_trade,
  list_sort(list(DISTINCT symbol)) AS symbols, count(*) FILTER (WHERE {_WON}) AS winning_trades, count(*) FILTER (WHERE NOT ({_WON})) AS losing_trades,
  sum(CASE WHEN {_WON} THEN {_GAIN} ELSE 0.0 END) AS profit, sum(CASE WHEN {_WON} THEN 0.0 ELSE {_GAIN} END) AS loss
  FROM (SELECT t.*, t.ts - t.ts % 3600 AS hour, m.mean_price FROM fx_trades t JOIN (SELECT symbol, ts - ts % 3600 AS hour, avg(price) AS mean_price FROM fx_trades GROUP BY 1, 2) m
    ON m.symbol = t.symbol AND m.hour = t.ts - t.ts % 3600) GROUP BY 1, 2""")
view("fx_ua", """SELECT user_id, hour + 3600 AS time_bucket, coalesce(trades_count, 0) AS trades_count, coalesce(total_volume, 0.0) AS total_volume,
  coalesce(r, 0.0) AS realized_pnl, coalesce(u, 0.0) AS unrealized_pnl, coalesce(r, 0.0) + coalesce(u, 0.0) AS total_pnl, coalesce(avg_trade_size, 0.0) AS avg_trade_size,
  coalesce(largest_trade, 0.0) AS largest_trade, coalesce(symbols, []) AS symbols, len(coalesce(symbols, [])) AS unique_symbols_count,
  coalesce(winning_trades, 0) AS winning_trades, coalesce(losing_trades, 0) AS losing_trades, coalesce(profit, 0.0) AS total_trades_profit, coalesce(loss, 0.0) AS total_trades_loss,
  coalesce(winning_trades / nullif(trades_count, 0) * 100, 0.0) AS win_rate, coalesce(profit / nullif(winning_trades, 0), 0.0) AS avg_profit_per_trade,
  coalesce(loss / nullif(losing_trades, 0), 0.0) AS avg_loss_per_trade, coalesce(profit / nullif(loss, 0), 0.0) AS profit_factor
  FROM fx_ua_base FULL JOIN (SELECT user_id, updated_at - updated_at % 3600 AS hour, sum(realized_pnl) AS r, sum(unrealized_pnl) AS u FROM fx_positions GROUP BY 1, 2) USING (user_id, hour)""")
view("fx_ua_hourly", """SELECT *, trades_count * 0.3 + least(total_volume / 10000, 100.0) * 0.3 + unique_symbols_count * 10 * 0.2 + least(abs(total_pnl) / 1000, 50.0) * 0.2 AS activity_score,
  CASE WHEN trades_count > 0 THEN least(largest_trade / nullif(avg_trade_size, 0), 10.0) * 2 + (100 - win_rate) / 10 + least(abs(total_pnl) / nullif(total_volume, 0) * 100, 10.0)
    ELSE 0.0 END AS risk_score FROM fx_ua""")
_TWO = "total_volume realized_pnl unrealized_pnl total_pnl largest_trade"
_FOUR = "avg_trade_size total_trades_profit total_trades_loss win_rate avg_profit_per_trade avg_loss_per_trade profit_factor activity_score risk_score"
_COLS = (["user_id", "time_bucket", "trades_count", "winning_trades", "losing_trades", "unique_symbols_count"], _TWO.split(), _FOUR.split())


def _shown(period):
    return (f"SELECT {', '.join(_COLS[0])}, '{period}' AS period_type, array_to_string(symbols, ',') AS symbols_traded, "
            + ", ".join(r2(c) for c in _COLS[1]) + ", " + ", ".join(r4(c) for c in _COLS[2]))


view("fx_ua_daily", """SELECT user_id, time_bucket - time_bucket % 86400 + 86400 AS time_bucket, cast(sum(trades_count) AS bigint) AS trades_count, sum(total_volume) AS total_volume,
  cast(sum(winning_trades) AS bigint) AS winning_trades, cast(sum(losing_trades) AS bigint) AS losing_trades, sum(total_trades_profit) AS total_trades_profit,
  sum(total_trades_loss) AS total_trades_loss, avg(realized_pnl) AS realized_pnl, avg(unrealized_pnl) AS unrealized_pnl, avg(total_pnl) AS total_pnl,
  avg(avg_trade_size) AS avg_trade_size, avg(win_rate) AS win_rate, avg(avg_profit_per_trade) AS avg_profit_per_trade, avg(avg_loss_per_trade) AS avg_loss_per_trade,
  avg(profit_factor) AS profit_factor, avg(activity_score) AS activity_score, avg(risk_score) AS risk_score, max(largest_trade) AS largest_trade,
  list_sort(list_distinct(flatten(list(symbols)))) AS symbols, len(list_distinct(flatten(list(symbols)))) AS unique_symbols_count FROM fx_ua_hourly GROUP BY 1, 2""")
_hourly = lambda fx: users.user_activity_hourly(fx.trades, fx.positions)
_daily = lambda fx: users.user_activity_daily(_hourly(fx))


def _show(df):
    return rounded(df, _TWO, _FOUR).withColumn("symbols_traded", F.array_join("symbols_traded", ","))


query("user_activity_hourly", _shown("hourly") + " FROM fx_ua_hourly")(lambda fx: _show(_hourly(fx)))
query("user_activity_daily", _shown("daily") + " FROM fx_ua_daily")(lambda fx: _show(_daily(fx)))
query("user_activity_summary", f"""SELECT user_id, time_bucket, trades_count, {r2('total_volume')}, {r2('total_pnl')}, {r4('win_rate')}, {r4('activity_score')}, {r4('risk_score')}
  FROM fx_ua_daily WHERE time_bucket BETWEEN {M0} AND {AS_OF}""")(
    lambda fx: rounded(users.user_activity_summary(_daily(fx), "daily", 30, AS_OF), "total_volume total_pnl", "win_rate activity_score risk_score"))
query("top_traders_by_activity", f"""SELECT user_id, {r2('sum(total_volume)', 'total_volume')}, {r2('sum(total_pnl)', 'total_pnl')},
  round(avg(activity_score) + 1e-9, 6) AS avg_activity_score, {r4('avg(win_rate)', 'avg_win_rate')}, cast(sum(trades_count) AS bigint) AS total_trades,
  {r4('avg(unique_symbols_count)', 'avg_symbols')} FROM fx_ua_daily WHERE time_bucket BETWEEN {W0} AND {AS_OF} GROUP BY 1 ORDER BY avg_activity_score DESC, user_id LIMIT 100""")(
    lambda fx: rounded(users.top_traders_by_activity(_daily(fx), "daily", 7, AS_OF), "total_volume total_pnl", "avg_win_rate avg_symbols"))
query("user_activity_list", _shown("daily").replace(r4("activity_score"), "round(activity_score + 1e-9, 6) AS activity_score") +
      f" FROM fx_ua_daily WHERE time_bucket BETWEEN {M0} AND {AS_OF} ORDER BY time_bucket DESC, round(activity_score + 1e-9, 6) DESC, user_id LIMIT 100")(
    lambda fx: rounded(users.user_activity_list(_daily(fx), "daily", 30, AS_OF), _TWO, _FOUR.replace(" activity_score", ""))
    .withColumn("symbols_traded", F.array_join("symbols_traded", ",")))
