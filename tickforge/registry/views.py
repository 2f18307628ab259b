"""DuckDB twins of the test views in ``tickforge.fixtures``."""

from tickforge.registry.core import view

AS_OF = 1706659200

view("fx_base", """SELECT event_id AS e, user_id AS u, event_type AS pool, value,
  cast(round(value * 100) AS bigint) AS p, cast(regexp_extract(props, '[0-9]+') AS bigint) + 1 AS q,
  cast(floor(epoch(ts)) AS bigint) AS t, CASE WHEN event_id % 7 = 3 THEN 2 ELSE 1 END AS chain,
  CASE WHEN event_id % 7 = 3 THEN event_id - 1 ELSE event_id END AS o FROM events""")

view("fx_trades", """SELECT chain AS chain_id, e AS trade_id, cast(u AS varchar) AS user_id, pool AS symbol, pool AS pool_id,
  CASE WHEN e % 2 = 0 THEN 'Buy' ELSE 'Sell' END AS side, e % 2 = 0 AS is_buyer, value AS price,
  cast(q AS double) AS quantity, value * cast(q AS double) AS quote_qty, t AS ts, CASE WHEN chain = 2 THEN e - 1000000000 ELSE e END AS seq FROM fx_base""")

_LOG = "e * 8 + {k} AS log_index, {t} AS block_timestamp, {o} AS order_id, {u} AS user_id, {s} AS side_code, {p} AS price, {q} AS quantity, {m} AS is_market, {st} AS status_code, {f} AS filled, {b} AS buy_order_id, {x} AS sell_order_id"


def _log(name, k, t, o, u="NULL", s="NULL", p="NULL", q="NULL", m="false", st="NULL", f="NULL", b="NULL", x="NULL", where=""):
    body = _LOG.format(k=k, t=t, o=o, u=u, s=s, p=p, q=q, m=m, st=st, f=f, b=b, x=x)
    return f"SELECT '{name}' AS event_name, chain AS chain_id, pool AS address, {body} FROM fx_base {where}"


_TAKER, _MAKER = "cast(u AS varchar)", "cast(u + 1 + e % 7 AS varchar)"
view("fx_log_rows", " UNION ALL ".join([
    _log("OrderPlaced", 0, "t", "o * 3", _TAKER, "cast(e % 2 AS int)", "p", "q", "e % 5 = 0", "0"),
    _log("OrderPlaced", 1, "t - 60", "o * 3 + 1", _MAKER, "1 - cast(e % 2 AS int)", "p", "q + e % 3", "false", "0"),
    _log("OrderPlaced", 2, "t + 1", "o * 3 + 2", _TAKER, "cast((e // 2) % 2 AS int)",
         "CASE WHEN (e // 2) % 2 = 0 THEN greatest(1, p * 9 // 10) ELSE p * 11 // 10 + 1 END", "q", "false", "0"),
    _log("OrderMatched", 3, "t", "NULL", _TAKER, "cast(e % 2 AS int)", "p", "q",
         b="CASE WHEN e % 2 = 0 THEN o * 3 ELSE o * 3 + 1 END", x="CASE WHEN e % 2 = 0 THEN o * 3 + 1 ELSE o * 3 END"),
    _log("OrderCancelled", 4, "t + 1 + (e % 72) * 3600", "o * 3 + 1", _MAKER, st="3", where="WHERE e % 3 = 2"),
    _log("UpdateOrder", 5, "t + 2 + (e % 72) * 3600", "o * 3 + 2", st="5", f="0", where="WHERE e % 4 = 1"),
    _log("OrderCancelled", 5, "t + 2 + (e % 72) * 3600", "o * 3 + 2", _TAKER, st="3", where="WHERE e % 4 = 2"),
    _log("UpdateOrder", 6, "t", "o * 3", st="2", f="q"),
    _log("UpdateOrder", 7, "t", "o * 3 + 1", st="CASE WHEN e % 3 = 0 THEN 2 ELSE 1 END", f="q"),
]))
view("fx_log", """SELECT *, block_timestamp AS block_number, sha256(cast(log_index AS varchar)) AS tx_hash,
  (cast(block_timestamp AS bigint) << 31) + log_index AS seq FROM fx_log_rows""")

view("fx_pools", """SELECT sha256(chain_id || '_' || symbol) AS id, chain_id, symbol || '/usd' AS coin, symbol AS order_book,
  0 AS base_decimals, 2 AS quote_decimals, min(ts) AS timestamp FROM fx_trades GROUP BY chain_id, symbol""")

view("fx_fills", """SELECT sha256(chain_id || '_' || tx_hash || '_' || buy_order_id || '_' || sell_order_id) AS fill_id, chain_id,
  address AS pool_id, buy_order_id, sell_order_id, user_id AS taker, CASE WHEN side_code = 1 THEN 'Sell' ELSE 'Buy' END AS side,
  price, quantity, block_timestamp AS ts, block_number, log_index, tx_hash, seq FROM fx_log WHERE event_name = 'OrderMatched'""")

view("fx_order_trades", """SELECT fill_id, chain_id, pool_id, 'Buy' AS side, buy_order_id AS order_id,
    side <> 'Buy' AS is_maker, price, quantity, ts, block_number, log_index, tx_hash, seq FROM fx_fills
  UNION ALL SELECT fill_id, chain_id, pool_id, 'Sell', sell_order_id, side <> 'Sell', price, quantity, ts,
    block_number, log_index, tx_hash, seq FROM fx_fills""")

view("fx_placed", """SELECT chain_id, address AS pool_id, order_id, user_id, CASE WHEN side_code = 1 THEN 'Sell' ELSE 'Buy' END AS side,
  price, quantity, CASE WHEN is_market THEN 'Market' ELSE 'Limit' END AS type,
  CASE status_code WHEN 0 THEN 'OPEN' WHEN 1 THEN 'PARTIALLY_FILLED' WHEN 2 THEN 'FILLED' WHEN 3 THEN 'CANCELLED'
    WHEN 4 THEN 'REJECTED' WHEN 5 THEN 'EXPIRED' END AS status, block_timestamp AS ts, seq
  FROM fx_log WHERE event_name = 'OrderPlaced'""")

view("fx_status_updates", """SELECT chain_id, address AS pool_id, order_id, max_by(status_code, seq) AS code, max_by(block_timestamp, seq) AS ts,
  max(seq) AS useq FROM fx_log WHERE event_name IN ('OrderCancelled', 'UpdateOrder') GROUP BY chain_id, address, order_id""")

view("fx_orders", """SELECT p.chain_id, p.pool_id, p.order_id, p.user_id, p.side, p.price, p.quantity, p.type,
  coalesce(f.filled, 0) AS filled,
  CASE WHEN u.code IS NOT NULL AND u.useq > coalesce(f.fseq, -1) THEN
      CASE u.code WHEN 0 THEN 'OPEN' WHEN 1 THEN 'PARTIALLY_FILLED' WHEN 2 THEN 'FILLED' WHEN 3 THEN 'CANCELLED'
        WHEN 4 THEN 'REJECTED' ELSE 'EXPIRED' END
    WHEN f.filled IS NOT NULL THEN CASE WHEN f.filled = p.quantity THEN 'FILLED' ELSE 'PARTIALLY_FILLED' END
    ELSE p.status END AS status,
  p.ts AS placed_at, coalesce(u.ts, p.ts) AS ts, p.seq
  FROM fx_placed p
  LEFT JOIN (SELECT chain_id, pool_id, order_id, cast(sum(quantity) AS bigint) AS filled, max(seq) AS fseq FROM fx_order_trades
             GROUP BY chain_id, pool_id, order_id) f USING (chain_id, pool_id, order_id)
  LEFT JOIN fx_status_updates u USING (chain_id, pool_id, order_id)""")

view("fx_order_history", """SELECT chain_id, pool_id, order_id, tx_hash, ts, filled, status, seq FROM (
  SELECT chain_id, address AS pool_id, order_id, tx_hash, block_timestamp AS ts, coalesce(filled, 0) AS filled,
   CASE status_code WHEN 0 THEN 'OPEN' WHEN 1 THEN 'PARTIALLY_FILLED' WHEN 2 THEN 'FILLED' WHEN 3 THEN 'CANCELLED'
    WHEN 4 THEN 'REJECTED' WHEN 5 THEN 'EXPIRED' END AS status, seq,
   row_number() OVER (PARTITION BY chain_id, address, order_id, tx_hash, coalesce(filled, 0) ORDER BY seq DESC) AS rn
  FROM fx_log WHERE event_name IN ('OrderPlaced', 'UpdateOrder', 'OrderCancelled')) WHERE rn = 1""")

view("fx_enriched", """SELECT t.chain_id, t.fill_id, o.user_id, p.coin AS symbol, t.pool_id, t.side, t.order_id, t.is_maker,
  t.price / pow(10.0, p.quote_decimals) AS price, t.quantity / pow(10.0, p.base_decimals) AS quantity,
  t.price / pow(10.0, p.quote_decimals) * (t.quantity / pow(10.0, p.base_decimals)) AS quote_qty, t.ts, t.seq, o.status
  FROM fx_order_trades t JOIN fx_orders o ON o.chain_id = t.chain_id AND o.pool_id = t.pool_id AND o.order_id = t.order_id
  JOIN fx_pools p ON p.chain_id = t.chain_id AND p.order_book = t.pool_id""")

view("fx_depth", """SELECT chain_id, pool_id, side, price, cast(sum(greatest(quantity - filled, 0)) AS bigint) AS quantity,
  count(*) AS order_count, max(ts) AS last_updated FROM fx_orders
  WHERE status IN ('NEW', 'OPEN', 'PARTIALLY_FILLED') GROUP BY ALL""")

view("fx_book_snapshots", """SELECT symbol, ts, seq, price * 0.999 AS best_bid, price * 1.001 AS best_ask
  FROM fx_trades WHERE side = 'Sell'""")

view("fx_ledger", """SELECT CASE pool WHEN 'signup' THEN 'deposit' WHEN 'view' THEN 'lock' WHEN 'click' THEN 'unlock'
    WHEN 'purchase' THEN 'withdraw' ELSE CASE WHEN e % 2 = 0 THEN 'transfer' ELSE 'transfer_locked' END END AS op,
  1 AS chain_id, cast(u AS varchar) AS user_id, 'c' || (e % 5) AS currency, p AS amount, p // 100 AS fee,
  cast(u + 1 + e % 7 AS varchar) AS receiver, 'operator' AS operator, t AS ts, t AS block_number, e AS log_index,
  sha256(cast(e AS varchar)) AS tx_hash, e AS seq FROM fx_base""")

view("fx_users", "SELECT user_id, min(ts) AS first_seen, max(ts) AS last_seen FROM fx_trades GROUP BY user_id")

view("fx_lending_raw", """SELECT CASE pool WHEN 'signup' THEN 'SUPPLY' WHEN 'view' THEN 'BORROW' WHEN 'click' THEN 'REPAY'
    WHEN 'purchase' THEN 'WITHDRAW' ELSE 'LIQUIDATE' END AS action, 1 AS chain_id, cast(u AS varchar) AS user_id,
  't' || (e % 40) AS token, 't' || ((e + 1) % 40) AS debt_token, p AS amount, p // 20 AS interest,
  cast(u + 3 AS varchar) AS liquidator, t AS ts, sha256(cast(e AS varchar)) AS tx_hash, e AS seq FROM fx_base""")

view("fx_oracle_events", """SELECT 1 AS chain_id, 't' || (e % 40) AS token, p AS price,
  CASE WHEN e % 3 = 0 THEN 'TWAP' END AS source, CASE WHEN e % 4 = 0 THEN 6 END AS decimals, t AS ts, e AS seq FROM fx_base""")

view("fx_asset_config_events", """SELECT 1 AS chain_id, 't' || (e % 40) AS token,
  cast(6000 + (q * 41) % 3000 AS hugeint) * 100000000000000 AS collateral_factor,
  cast(7000 + (q * 37) % 2000 AS hugeint) * 100000000000000 AS liquidation_threshold,
  cast(500 + q AS hugeint) * 100000000000000 AS liquidation_bonus,
  cast((q % 20) * 100 AS hugeint) * 100000000000000 AS reserve_factor, t AS ts, e AS seq FROM fx_base""")

view("fx_bridge_messages", """SELECT CASE WHEN e % 3 = 1 THEN e - 1 ELSE e END AS message_id,
  CASE WHEN e % 3 = 1 THEN 'PROCESS' ELSE 'DISPATCH' END AS type, CASE WHEN e % 3 = 1 THEN 2 ELSE 1 END AS chain_id,
  'tx' || e AS tx_hash, cast(u AS varchar) AS user_id, t AS ts, e AS seq FROM fx_base""")

view("fx_bridge_deposits", """SELECT e AS deposit_id, 1 AS chain_id, cast(u AS varchar) AS user_id, 'c' || (e % 5) AS token,
  p AS amount, 'tx' || e AS tx_hash, t AS ts, e AS seq FROM fx_base""")

view("fx_chain_balance", """SELECT CASE pool WHEN 'signup' THEN 'deposit' WHEN 'purchase' THEN 'withdraw'
    WHEN 'click' THEN 'unlock' WHEN 'view' THEN 'claim' ELSE 'whitelist' END AS op, 1 AS chain_id,
  cast(u AS varchar) AS user_id, 'c' || (e % 5) AS token, p AS amount, q % 2 = 0 AS is_whitelisted,
  sha256(cast(e AS varchar)) AS tx_hash, e AS log_index, t AS ts, e AS seq FROM fx_base""")

view("fx_registry", """SELECT op, cast(token % 3 + 1 AS int) AS source_chain, '0x' || token AS source_token,
  cast(token % 2 + 100 AS int) AS target_chain, CASE WHEN op IN ('register', 'update') THEN '0xs' || k END AS synthetic_token,
  CASE WHEN op = 'register' THEN 'SYM' || token END AS symbol,
  CASE WHEN op = 'register' THEN p_size % 18 + 1 END AS source_decimals,
  CASE op WHEN 'toggle' THEN p_size % 2 = 0 WHEN 'deactivate' THEN false WHEN 'register' THEN true END AS is_active, k AS seq
  FROM (SELECT p_partkey AS k, p_partkey // 4 AS token, p_size, CASE p_partkey % 4 WHEN 0 THEN 'register' WHEN 1 THEN 'update'
    WHEN 2 THEN 'toggle' ELSE CASE WHEN p_partkey % 3 = 0 THEN 'deactivate' ELSE 'update' END END AS op FROM part)""")

view("fx_currencies", """SELECT 'c' || p_partkey AS address, 1 AS chain_id,
  'gs' || upper(substring(p_type, 1, 3)) || p_partkey AS symbol, p_name AS name, p_size % 3 AS decimals,
  CASE WHEN p_size % 2 = 0 THEN 'underlying' ELSE 'synthetic' END AS token_type, p_size % 5 <> 0 AS is_active,
  p_partkey AS seq FROM part""")

view("fx_faucet", """SELECT e // 3 AS request_id, '0xAb' || ((e // 3) % 50) AS address, cast((e // 3) % 2 + 1 AS int) AS chain_id,
  CASE e % 3 WHEN 0 THEN 'pending' WHEN 1 THEN NULL ELSE CASE WHEN q % 4 = 0 THEN 'failed' ELSE 'completed' END END AS status,
  CASE WHEN e % 3 = 1 THEN 'tx' || e END AS tx_hash, CASE WHEN e % 3 = 2 AND q % 4 = 0 THEN 'rejected' END AS error,
  t AS ts, e AS seq FROM fx_base""")

view("fx_sync_log", """SELECT e AS trade_id, 'analytics' AS service, CASE WHEN t < 1704153600
    OR t BETWEEN 1704844800 AND 1704931200 OR t >= 1706572800 THEN 'pending' ELSE 'processed' END AS status,
  t AS processed_at FROM fx_base""")

view("fx_hourly_pnl", """SELECT ts - ts % 3600 AS bucket, user_id,
  round(sum(CASE WHEN is_buyer THEN -quote_qty ELSE quote_qty END), 2) AS total_pnl,
  round(sum(CASE WHEN is_buyer THEN 0.0 ELSE quote_qty END), 2) AS total_realized_pnl,
  round(sum(CASE WHEN is_buyer THEN -quote_qty ELSE 0.0 END), 2) AS total_unrealized_pnl,
  count(*) AS trades_count, round(sum(quote_qty), 2) AS volume_traded FROM fx_trades GROUP BY 1, 2""")

view("fx_positions", """SELECT user_id, symbol, sum(CASE WHEN is_buyer THEN quantity ELSE -quantity END) AS quantity,
  round(avg(price) + 1e-9, 4) AS avg_cost,
  round(sum(CASE WHEN is_buyer THEN 0.0 ELSE quote_qty END) - sum(CASE WHEN is_buyer THEN quote_qty ELSE 0.0 END), 2) AS realized_pnl,
  round(sum(CASE WHEN is_buyer THEN quantity ELSE -quantity END) * 0.5, 2) AS unrealized_pnl, max(ts) AS updated_at
  FROM fx_trades GROUP BY user_id, symbol""")
