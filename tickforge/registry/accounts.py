"""Balances, lending, bridge, token registry and faucet."""

from pyspark.sql import functions as F

from tickforge.fixtures import AS_OF
from tickforge.functions.columns import currency_address_from_long, r, row_key
from tickforge.plans import bridge, ledger, lending
from tickforge.registry.core import nudged, query, view

# --- ledger --------------------------------------------------------------------------------------
view("fx_moves", """SELECT chain_id, currency, ts, block_number, seq, user_id, CASE op WHEN 'deposit' THEN amount WHEN 'withdraw' THEN -amount
    WHEN 'lock' THEN -amount WHEN 'unlock' THEN amount WHEN 'transfer' THEN -amount ELSE 0 END AS d_amount,
    CASE op WHEN 'lock' THEN amount WHEN 'unlock' THEN -amount WHEN 'transfer_locked' THEN -amount ELSE 0 END AS d_locked, 0 AS leg FROM fx_ledger
  UNION ALL SELECT chain_id, currency, ts, block_number, seq, receiver, amount - fee, 0, 1 FROM fx_ledger WHERE op LIKE 'transfer%'
  UNION ALL SELECT chain_id, currency, ts, block_number, seq, operator, fee, 0, 2 FROM fx_ledger WHERE op LIKE 'transfer%'""")
view("fx_balances", """SELECT chain_id, user_id, currency, cast(sum(d_amount) AS bigint) AS amount, cast(sum(d_locked) AS bigint) AS locked,
  max(ts) AS last_updated FROM fx_moves GROUP BY 1, 2, 3""")
query("balance_ledger", "SELECT * FROM fx_balances")(lambda fx: ledger.balance_ledger(fx.ledger_events))
query("balance_history", """SELECT chain_id, user_id, currency, ts, seq, leg, d_amount, d_locked,
  cast(sum(d_amount) OVER w AS bigint) AS available, cast(sum(d_locked) OVER w AS bigint) AS locked FROM fx_moves
  WINDOW w AS (PARTITION BY chain_id, user_id, currency ORDER BY seq, leg ROWS UNBOUNDED PRECEDING)""")(
    lambda fx: ledger.balance_history(fx.ledger_events))
for _op, _key in (("deposit", "deposits_table"), ("withdraw", "withdrawals_table")):
    query(_key, f"SELECT chain_id, tx_hash, currency, user_id, amount, ts, block_number, seq FROM fx_ledger WHERE op = '{_op}'")(
        lambda fx, op=_op: ledger.keyed_log(fx.ledger_events, op))
query("currency_id_to_address", "SELECT e AS id, '0x' || lpad(lower(to_hex(e)), 40, '0') AS address FROM fx_base")(
    lambda fx: fx.base.select(F.col("e").alias("id"), currency_address_from_long("e").alias("address")))
query("chain_balance_state", """SELECT chain_id, user_id, token,
  cast(sum(CASE op WHEN 'deposit' THEN amount WHEN 'withdraw' THEN -amount WHEN 'unlock' THEN -amount ELSE 0 END) AS bigint) AS balance,
  cast(sum(CASE op WHEN 'unlock' THEN amount WHEN 'claim' THEN -amount ELSE 0 END) AS bigint) AS unlocked, max(ts) AS last_updated
  FROM fx_chain_balance WHERE op <> 'whitelist' GROUP BY 1, 2, 3""")(lambda fx: ledger.chain_balance_state(fx.chain_balance_events))
query("chain_balance_logs", """SELECT CASE op WHEN 'deposit' THEN 'deposit' WHEN 'unlock' THEN 'unlock' ELSE 'withdrawal' END AS log,
  CASE WHEN op IN ('withdraw', 'claim') THEN op END AS withdrawal_type, chain_id, user_id, token, amount, tx_hash, log_index, ts
  FROM fx_chain_balance WHERE op <> 'whitelist'""")(lambda fx: ledger.chain_balance_logs(fx.chain_balance_events))
query("token_whitelist", """SELECT chain_id, token, max_by(is_whitelisted, seq) AS is_whitelisted, max(ts) AS last_updated, count(*) AS changes
  FROM fx_chain_balance WHERE op = 'whitelist' GROUP BY 1, 2""")(lambda fx: ledger.token_whitelist(fx.chain_balance_events))
query("account_balances", """SELECT b.chain_id, b.user_id, b.currency, coalesce(c.symbol, 'UNKNOWN') AS asset, coalesce(c.decimals, 18) AS decimals,
  greatest(b.amount, 0) AS free, greatest(b.locked, 0) AS locked FROM fx_balances b
  LEFT JOIN fx_currencies c ON lower(c.address) = lower(b.currency) AND c.chain_id = b.chain_id""")(
    lambda fx: ledger.account_balances(ledger.balance_ledger(fx.ledger_events), fx.currencies))
query("balances_total", "SELECT chain_id, user_id, currency, amount AS available, locked, amount + locked AS total FROM fx_balances")(
    lambda fx: ledger.balances_total(ledger.balance_ledger(fx.ledger_events)))

_RECIPES = {
    "order_key": (["1", "pool", "e"], "'1_' || pool || '_' || e"),
    "bucket_key": (["1", "pool", "hour"], "'1_' || pool || '_' || (t - t % 3600)"),
    "trade_key": (["1", "tx", "u", "side", "buy", "sell", "p", "q"], "'1_tx' || e || '_' || u || '_' || CASE WHEN e % 2 = 0 THEN 'Buy' ELSE 'Sell' END || '_' || e || '_' || (e + 1) || '_' || p || '_' || q"),
    "order_history_key": (["1", "pool", "e", "tx", "q"], "'1_' || pool || '_' || e || '_tx' || e || '_' || q"),
    "pool_key": (["1", "pool"], "'1_' || pool"),
    "balance_key": (["1", "currency", "u"], "'1_c' || (e % 5) || '_' || u"),
    "currency_key": (["1", "currency"], "'1_c' || (e % 5)"),
    "lending_position_key": (["1", "u", "token", "debt"], "'1_' || u || '_t' || (e % 40) || '_t' || ((e + 1) % 40)"),
    "lending_event_key": (["1", "tx", "action", "u", "t"], "'1_tx' || e || '_SUPPLY_' || u || '_' || t"),
    "yield_key": (["1", "u", "token", "kind", "t"], "'1_' || u || '_t' || (e % 40) || '_LENDING_' || t"),
    "liquidation_key": (["1", "tx", "u", "t"], "'1_tx' || e || '_' || u || '_' || t"),
    "synthetic_key": (["1", "syn", "token"], "'1_synthetic_t' || (e % 40)"),
    "oracle_key": (["1", "token", "t"], "'1_t' || (e % 40) || '_' || t"),
}


@query("row_key_sha256", "SELECT e, " + ", ".join(f"sha256({s}) AS {k}" for k, (_, s) in _RECIPES.items()) + " FROM fx_base")
def row_keys(fx):
    e = F.col("e")
    named = {
        "1": F.lit(1), "pool": F.col("pool"), "e": e, "u": F.col("u"), "p": F.col("p"), "q": F.col("q"), "t": F.col("t"),
        "hour": F.col("t") - F.col("t") % 3600, "tx": F.concat(F.lit("tx"), e.cast("string")),
        "side": F.when(e % 2 == 0, "Buy").otherwise("Sell"), "buy": e, "sell": e + 1,
        "currency": F.concat(F.lit("c"), (e % 5).cast("string")), "token": F.concat(F.lit("t"), (e % 40).cast("string")),
        "debt": F.concat(F.lit("t"), ((e + 1) % 40).cast("string")), "action": F.lit("SUPPLY"), "kind": F.lit("LENDING"),
        "syn": F.lit("synthetic")}
    return fx.base.select("e", *[row_key(*[named[p] for p in parts]).alias(k) for k, (parts, _) in _RECIPES.items()])


# --- lending -------------------------------------------------------------------------------------
view("fx_lending", """SELECT sha256('1_' || tx_hash || '_' || action || '_' || user_id || '_' || ts) AS id, chain_id, action, user_id, token,
  CASE WHEN action = 'LIQUIDATE' THEN debt_token END AS debt_token, CASE WHEN action = 'LIQUIDATE' THEN liquidator END AS liquidator, ts, tx_hash,
  cast(sum(CASE WHEN action = 'REPAY' THEN amount + interest ELSE amount END) AS bigint) AS amount, max(seq) AS seq FROM fx_lending_raw GROUP BY ALL""")
_events = lambda fx: lending.lending_events_log(fx.lending_raw)
query("lending_events_log", "SELECT * FROM fx_lending")(_events)


def _s(action, out):
    return f"cast(sum(CASE WHEN action = '{action}' THEN amount ELSE 0 END) AS bigint) AS {out}"


view("fx_lend_pos", f"""SELECT chain_id, user_id, token, {_s('SUPPLY', 'collateral_amount')}, {_s('BORROW', 'debt_amount')}, max(ts) AS last_updated
  FROM fx_lending WHERE action IN ('SUPPLY', 'BORROW') GROUP BY 1, 2, 3""")
_positions = lambda fx: lending.lending_positions(_events(fx))
query("lending_positions", "SELECT * FROM fx_lend_pos")(_positions)
query("user_lending_stats", f"""SELECT chain_id, user_id, {_s('SUPPLY', 'total_supplied')}, {_s('BORROW', 'total_borrowed')}, {_s('REPAY', 'total_repaid')},
  {_s('WITHDRAW', 'total_withdrawn')}, count(*) FILTER (WHERE action = 'LIQUIDATE') AS total_liquidations, {_s('LIQUIDATE', 'total_liquidated_amount')},
  min(ts) AS first_activity, max(ts) AS last_activity FROM fx_lending GROUP BY 1, 2""")(lambda fx: lending.user_lending_stats(_events(fx)))
query("lending_balance_effect", """SELECT chain_id, user_id, token, cast(sum(CASE WHEN action = 'REPAY' THEN amount
  WHEN action IN ('BORROW', 'WITHDRAW') THEN -amount ELSE 0 END) AS bigint) AS d_amount,
  arg_max(amount, seq) FILTER (WHERE action = 'SUPPLY') AS locked_set FROM fx_lending WHERE action <> 'LIQUIDATE' GROUP BY 1, 2, 3""")(
    lambda fx: lending.lending_balance_effect(_events(fx)))
query("synthetic_supply", """SELECT t.chain_id, t.token, t.total_supply - coalesce(w.amount, 0) AS total_supply
  FROM (SELECT chain_id, token, cast(sum(amount) AS bigint) * 3 AS total_supply FROM fx_lending GROUP BY 1, 2) t
  LEFT JOIN (SELECT chain_id, token, cast(sum(amount) AS bigint) AS amount FROM fx_lending WHERE action = 'WITHDRAW' GROUP BY 1, 2) w USING (chain_id, token)""")(
    lambda fx: lending.synthetic_supply(
        _events(fx).groupBy("chain_id", "token").agg((F.sum("amount") * 3).alias("total_supply")), _events(fx)))
query("liquidations_table", """SELECT sha256('1_' || tx_hash || '_' || user_id || '_' || ts) AS id, chain_id, user_id AS liquidated_user, liquidator,
  token AS collateral_token, debt_token, amount AS debt_to_cover, 1000 AS liquidation_bonus, 0 AS liquidation_fee, 0 AS price, ts, tx_hash
  FROM fx_lending_raw WHERE action = 'LIQUIDATE'""")(lambda fx: lending.liquidations_table(fx.lending_raw))
query("oracle_price_log", """SELECT sha256('1_' || token || '_' || ts) AS id, chain_id, token, arg_max(price, seq) AS price,
  arg_max(coalesce(source, 'CHAINLINK'), seq) AS source, arg_max(coalesce(decimals, 18), seq) AS decimals, ts, max(seq) AS seq
  FROM fx_oracle_events GROUP BY chain_id, token, ts""")(lambda fx: lending.oracle_price_log(fx.oracle_events))
_bps = lambda c: f"cast(arg_max({c}, seq) // 100000000000000 AS int) AS {c}"
view("fx_configs", f"""SELECT chain_id, token, {_bps('collateral_factor')}, {_bps('liquidation_threshold')}, {_bps('liquidation_bonus')},
  {_bps('reserve_factor')}, arg_max(ts, seq) AS ts, true AS is_active FROM fx_asset_config_events GROUP BY 1, 2""")
_configs = lambda fx: lending.asset_config_state(fx.asset_config_events)
query("asset_config_state", "SELECT * FROM fx_configs")(_configs)
view("fx_rates", """SELECT chain_id, token, CASE WHEN collateral_factor >= 8000 THEN 150 WHEN collateral_factor >= 7500 THEN 250
  WHEN collateral_factor >= 7000 THEN 350 ELSE 500 END AS supply_rate, (CASE WHEN collateral_factor >= 8000 THEN 400 WHEN collateral_factor >= 7500 THEN 600
  WHEN collateral_factor >= 7000 THEN 800 ELSE 1200 END) + reserve_factor / cast(10 AS double) AS borrow_rate, ts AS last_updated FROM fx_configs""")
_rates = lambda fx: lending.pool_lending_rates(_configs(fx))
query("pool_lending_rates", "SELECT * FROM fx_rates")(_rates)

# Lending tokens are listed in the currency view under the same number ('t7' is part row 7).
view("fx_lend_tokens", "SELECT 't' || substring(address, 2) AS address, chain_id, symbol, decimals FROM fx_currencies")
_tokens = lambda fx: fx.currencies.withColumn("address", F.concat(F.lit("t"), F.expr("substring(address, 2)")))


def _strip(sym):
    return f"CASE WHEN {sym} LIKE 'gs%' THEN substring({sym}, 3) ELSE coalesce({sym}, 'UNKNOWN') END"


view("fx_supplies", f"""SELECT p.chain_id, p.user_id, p.token, {_strip('c.symbol')} AS asset,
  p.collateral_amount / pow(10.0, coalesce(c.decimals, 18)) AS supplied, cast(coalesce(r.supply_rate, 0) AS double) AS rate_bps
  FROM fx_lend_pos p LEFT JOIN fx_lend_tokens c ON lower(c.address) = lower(p.token) LEFT JOIN fx_rates r ON r.token = p.token WHERE collateral_amount > 0""")
view("fx_borrows", f"""SELECT p.chain_id, p.user_id, p.token, {_strip('c.symbol')} AS asset,
  p.debt_amount / pow(10.0, coalesce(c.decimals, 18)) AS borrowed, coalesce(r.borrow_rate, 0.0) AS rate_bps,
  (cast(p.user_id AS int) % 30) / cast(10 AS double) AS health_factor
  FROM fx_lend_pos p LEFT JOIN fx_lend_tokens c ON lower(c.address) = lower(p.token) LEFT JOIN fx_rates r ON r.token = p.token WHERE debt_amount > 0""")
_sup = lambda fx: lending.lending_supplies(_positions(fx), _rates(fx), _tokens(fx))
_health = lambda fx: fx.users.select("user_id", ((F.col("user_id").cast("int") % 30) / 10.0).alias("health_factor"))
_bor = lambda fx: lending.lending_borrows(_positions(fx), _rates(fx), _tokens(fx), _health(fx))
query("lending_supplies", """SELECT chain_id, user_id, token, asset, supplied, format('{:,.2f}', supplied) AS supplied_text,
  '$' || format('{:,.2f}', supplied) AS value_text, rate_bps, format('{:.1f}', rate_bps / 100) || '%' AS apy FROM fx_supplies""")(_sup)
query("lending_borrows", """SELECT chain_id, user_id, token, asset, borrowed, '$' || format('{:,.2f}', borrowed) AS debt_text, rate_bps,
  format('{:.1f}', round_even(rate_bps / 100, 1)) || '%' AS apy, health_factor, CASE WHEN health_factor < 1.5 THEN 'danger' WHEN health_factor < 2.0 THEN 'warning' ELSE 'safe' END AS health_status FROM fx_borrows""")(_bor)
query("lending_available_to_supply", f"""SELECT c.chain_id, u.user_id, c.token, {_strip('t.symbol')} AS asset, coalesce(s.supplied, 0.0) AS supplied,
  format('{{:.1f}}', round_even(coalesce(r.supply_rate, 0) / cast(100 AS double), 1)) || '%' AS apy, true AS can_supply, {_strip('t.symbol')} = 'USDC' AS recommended FROM fx_users u
  CROSS JOIN fx_configs c LEFT JOIN fx_lend_tokens t ON lower(t.address) = lower(c.token) LEFT JOIN fx_rates r ON r.token = c.token AND r.chain_id = c.chain_id LEFT JOIN fx_supplies s ON s.user_id = u.user_id AND s.token = c.token AND s.chain_id = c.chain_id""")(
    lambda fx: lending.lending_available_to_supply(fx.users, _configs(fx), _sup(fx), _rates(fx), _tokens(fx)))
query("lending_available_to_borrow", """SELECT user_id, token, cast(floor(round(collateral, 2) * (collateral_factor / cast(10000 AS double))) AS bigint) AS available,
  round(collateral_factor / cast(10000 AS double) * 100, 4) AS collateral_factor, round(liquidation_threshold / cast(100 AS double), 4) AS liquidation_threshold
  FROM (SELECT user_id, sum(supplied) AS collateral FROM fx_supplies GROUP BY 1) CROSS JOIN fx_configs WHERE collateral > 0""")(
    lambda fx: lending.lending_available_to_borrow(_sup(fx).withColumn("supplied", r("supplied", 2)), _configs(fx))
    .withColumn("collateral_factor", r("collateral_factor")).withColumn("liquidation_threshold", r("liquidation_threshold")))
query("lending_summary", """SELECT user_id, round(coalesce(ts, 0.0), 2) AS total_supplied, round(coalesce(tb, 0.0), 2) AS total_borrowed,
  round(coalesce(w / nullif(ts, 0), 0.0) / 100 + 1e-9, 4) AS net_apy, coalesce(hf, 999999.0) AS health_factor,
  round(coalesce(ts, 0.0) * 0.8 + 1e-9, 2) AS borrowing_power
  FROM (SELECT user_id, sum(supplied) AS ts, sum(rate_bps * supplied) AS w FROM fx_supplies GROUP BY 1)
  FULL JOIN (SELECT user_id, sum(borrowed) AS tb, min(health_factor) AS hf FROM fx_borrows GROUP BY 1) USING (user_id)""")(
    lambda fx: lending.lending_summary(_sup(fx), _bor(fx)).select(
        "user_id", r("total_supplied", 2).alias("total_supplied"), r("total_borrowed", 2).alias("total_borrowed"),
        nudged("net_apy").alias("net_apy"), "health_factor", nudged("borrowing_power", 2).alias("borrowing_power")))

# --- bridge, registry, faucet --------------------------------------------------------------------
query("bridge_messages", "SELECT * FROM fx_bridge_messages")(lambda fx: bridge.bridge_messages(fx.bridge_messages))
query("bridge_links", """SELECT message_id, s.chain_id AS source_chain, s.tx_hash AS source_tx, s.ts AS source_ts, t.chain_id AS target_chain,
  t.tx_hash AS target_tx, t.ts AS target_ts, CASE WHEN t.tx_hash IS NOT NULL THEN 'RELAYED' ELSE 'SENT' END AS status
  FROM (SELECT * FROM fx_bridge_messages WHERE type = 'DISPATCH') s FULL JOIN (SELECT * FROM fx_bridge_messages WHERE type = 'PROCESS') t USING (message_id)""")(
    lambda fx: bridge.bridge_links(bridge.bridge_messages(fx.bridge_messages)))
query("bridge_transfers", """SELECT tx_hash, d.deposit_id, m.message_id, d.user_id, d.token, d.amount, coalesce(d.ts, m.ts) AS ts,
  CASE WHEN m.message_id IS NOT NULL THEN 'SENT' ELSE 'PENDING' END AS status FROM fx_bridge_deposits d
  FULL JOIN (SELECT * FROM fx_bridge_messages WHERE type = 'DISPATCH') m USING (tx_hash)""")(
    lambda fx: bridge.bridge_transfers(fx.bridge_deposits, fx.bridge_messages))


@query("bridge_deposit_status", """SELECT user_id, deposit_id, token, amount, tx_hash, message_id, status, ts, dispatch_ts, process_chain, process_tx FROM (
  SELECT d.user_id, d.deposit_id, d.token, d.amount, d.tx_hash, s.message_id, d.ts, s.ts AS dispatch_ts, t.chain_id AS process_chain, t.tx_hash AS process_tx,
   CASE WHEN t.tx_hash IS NOT NULL THEN 'RELAYED' WHEN s.message_id IS NOT NULL THEN 'SENT' ELSE 'PENDING' END AS status,
   row_number() OVER (PARTITION BY d.user_id ORDER BY d.ts DESC, d.seq DESC) AS rn FROM fx_bridge_deposits d
  LEFT JOIN (SELECT * FROM fx_bridge_messages WHERE type = 'DISPATCH') s ON s.tx_hash = d.tx_hash
  LEFT JOIN (SELECT * FROM fx_bridge_messages WHERE type = 'PROCESS') t ON t.message_id = s.message_id) WHERE rn <= 50""")
def bridge_deposit_status(fx):
    out = bridge.bridge_deposit_status(fx.bridge_deposits, fx.bridge_messages)
    return out.select("user_id", "deposit_id", "token", "amount", "tx_hash", "message_id", "status", "ts",
                      F.col("dispatch.ts").alias("dispatch_ts"), F.col("process.chain_id").alias("process_chain"),
                      F.col("process.tx_hash").alias("process_tx"))


_lastnn = lambda c: f"arg_max({c}, seq) FILTER (WHERE {c} IS NOT NULL) AS {c}"
view("fx_mappings", f"""SELECT * FROM (SELECT source_chain, source_token, target_chain, {_lastnn('synthetic_token')}, {_lastnn('symbol')},
  {_lastnn('source_decimals')}, {_lastnn('is_active')}, max(seq) AS seq FROM fx_registry WHERE source_chain <> 3 OR op = 'toggle' GROUP BY 1, 2, 3)
  WHERE synthetic_token IS NOT NULL""")
_mappings = lambda fx: bridge.token_mapping_state(fx.registry_events, [3])
query("token_mapping_state", "SELECT * FROM fx_mappings")(_mappings)
query("currencies_from_mappings", """SELECT chain_id, address, arg_max(symbol, seq) AS symbol, arg_max(token_type, seq) AS token_type,
  arg_max(decimals, seq) AS decimals, arg_max(is_active, seq) AS is_active, max(seq) AS seq FROM (
  SELECT source_chain AS chain_id, lower(source_token) AS address, coalesce(symbol, 'UNKNOWN') AS symbol, 'underlying' AS token_type,
    coalesce(source_decimals, 18) AS decimals, is_active, seq FROM fx_mappings
  UNION ALL SELECT target_chain, lower(synthetic_token), 'gs' || coalesce(symbol, 'UNKNOWN'), 'synthetic', coalesce(source_decimals, 18), is_active, seq
  FROM fx_mappings) GROUP BY 1, 2""")(lambda fx: bridge.currencies_from_mappings(_mappings(fx)))
query("token_mappings", "SELECT * FROM fx_mappings WHERE is_active ORDER BY seq DESC LIMIT 100")(
    lambda fx: bridge.token_mappings(_mappings(fx), active=True))
query("token_info", """SELECT a.address, a.chain_id, coalesce(c.symbol, 'UNKNOWN') AS symbol, coalesce(c.name, 'Unknown Token') AS name,
  coalesce(c.decimals, 18) AS decimals FROM (SELECT DISTINCT lower(currency) AS address, 1 + op_no AS chain_id FROM (SELECT currency, CASE WHEN op = 'lock' THEN 1 ELSE 0 END AS op_no FROM fx_ledger)) a
  LEFT JOIN fx_currencies c ON lower(c.address) = a.address AND c.chain_id = a.chain_id""")(
    lambda fx: bridge.token_info(fx.ledger_events.select(
        F.upper("currency").alias("address"), (F.lit(1) + (F.col("op") == "lock").cast("int")).alias("chain_id")), fx.currencies))
query("currencies_list", """SELECT *, (SELECT count(*) FROM fx_currencies WHERE is_active AND token_type = 'underlying') AS total FROM fx_currencies
  WHERE is_active AND token_type = 'underlying' ORDER BY symbol, address LIMIT 50 OFFSET 20""")(
    lambda fx: bridge.currencies_list(fx.currencies, 50, 20, token_type="underlying"))
query("currency_by_address", "SELECT * FROM fx_currencies WHERE lower(address) = 'c7' AND chain_id = 1")(
    lambda fx: bridge.currency_by_address(fx.currencies, "C7", 1))
view("fx_faucet_state", f"""SELECT request_id, {_lastnn('address')}, {_lastnn('chain_id')}, {_lastnn('status')}, {_lastnn('tx_hash')}, {_lastnn('error')},
  min(ts) AS created_at, max(ts) AS updated_at FROM fx_faucet GROUP BY 1""")
_faucet = lambda fx: bridge.faucet_request_state(fx.faucet_events)
query("faucet_request_state", "SELECT * FROM fx_faucet_state")(_faucet)
query("faucet_history", "SELECT * FROM fx_faucet_state WHERE lower(address) = '0xab7' ORDER BY created_at, request_id LIMIT 50")(
    lambda fx: bridge.faucet_history(_faucet(fx), "0xAB7"))
