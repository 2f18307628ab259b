"""Explicit schemas of the state tables, typed streams and documents.

Raw on-chain amounts are DECIMAL(38,0), epoch seconds BIGINT, addresses lower-cased text.
"""

from __future__ import annotations


RAW, TS = "decimal(38,0)", "bigint"
_ID = "id string, chain_id int"

EVENT_LOG = f"""event_name string, chain_id int, address string, block_number bigint, block_timestamp {TS}, tx_hash string,
  log_index int, order_id bigint, user_id string, side_code int, price {RAW}, quantity {RAW}, expiry {TS}, is_market boolean,
  status_code int, filled {RAW}, buy_order_id bigint, sell_order_id bigint"""

STATIC_POOLS = """data struct<poolss:struct<items:array<struct<id:string,chainId:int,coin:string,orderBook:string,baseDecimals:int,
  quoteDecimals:int,price:string,volume:string,volumeInQuote:string,timestamp:bigint,
  baseCurrency:struct<address:string,chainId:int,decimals:int,name:string,id:string,symbol:string>,
  quoteCurrency:struct<address:string,chainId:int,decimals:int,name:string,id:string,symbol:string>>>>>"""

METRICS = "ts bigint, connections bigint, messages bigint, memory_bytes bigint, orders bigint, trades bigint"

# Merge key per table; the tuple is (columns, key).
STATE_TABLES: dict[str, tuple[str, tuple[str, ...]]] = {
    "pools": (f"{_ID}, coin string, order_book string, base_currency string, quote_currency string, base_decimals int, quote_decimals int, volume {RAW}, volume_in_quote {RAW}, price {RAW}, timestamp {TS}", ("id",)),
    "orders": (f"{_ID}, user string, pool_id string, order_id bigint, transaction_id string, side string, timestamp {TS}, price {RAW}, quantity {RAW}, order_value {RAW}, filled {RAW}, type string, status string, expiry {TS}", ("id",)),
    "order_history": (f"{_ID}, pool_id string, order_id bigint, transaction_id string, timestamp {TS}, quantity {RAW}, filled {RAW}, status string", ("id",)),
    "order_book_depth": (f"{_ID}, pool_id string, side string, price {RAW}, quantity {RAW}, order_count int, last_updated {TS}", ("pool_id", "side", "price")),
    "trades": (f"{_ID}, transaction_id string, pool_id string, order_id string, price {RAW}, quantity {RAW}, timestamp {TS}", ("id",)),
    "order_book_trades": (f"{_ID}, price {RAW}, quantity {RAW}, timestamp {TS}, transaction_id string, side string, pool_id string", ("id",)),
    "klines": (f"{_ID}, interval string, open_time {TS}, close_time {TS}, open double, high double, low double, close double, average double, volume double, quote_volume double, count int, taker_buy_base_volume double, taker_buy_quote_volume double, pool_id string", ("chain_id", "pool_id", "interval", "open_time")),
    "balances": (f"{_ID}, user string, currency string, amount {RAW}, locked_amount {RAW}", ("chain_id", "currency", "user")),
    "market_makers": (f"{_ID}, user string, pool_id string, amount {RAW}, expiry {TS}", ("id",)),
    "velock_positions": (f"{_ID}, user string, amount {RAW}, expiry {TS}", ("id",)),
    "votes": (f"{_ID}, user string, pool_id string, amount {RAW}, timestamp {TS}", ("id",)),
    "currencies": (f"{_ID}, address string, name string, symbol string, decimals int, token_type string, source_chain_id int, underlying_token_address string, is_active boolean, registered_at {TS}", ("chain_id", "address")),
    "faucet_requests": (f"{_ID}, requester_address string, receiver_address string, token_address string, amount {RAW}, status string, transaction_hash string, error_message string, request_timestamp {TS}, completed_timestamp {TS}", ("id",)),
    "faucet_deposits": (f"{_ID}, depositor string, token string, amount {RAW}, transaction_hash string, timestamp {TS}", ("id",)),
    "faucet_rate_limits": (f"identifier string, identifier_type string, request_count int, window_start {TS}, last_request_time {TS}, cooldown_until {TS}", ("identifier", "identifier_type")),
    "cross_chain_transfers": (f"id string, source_chain_id int, destination_chain_id int, sender string, recipient string, source_token string, destination_token string, amount {RAW}, source_transaction_hash string, message_id string, status string, direction string, timestamp {TS}", ("id",)),
    "bridge_messages": (f"{_ID}, message_id string, sender string, type string, transaction_hash string, block_number bigint, timestamp {TS}", ("message_id", "type")),
    "cross_chain_message_links": (f"message_id string, source_chain int, target_chain int, source_tx string, target_tx string, source_ts {TS}, target_ts {TS}, status string", ("message_id",)),
    "chain_balance_deposits": (f"{_ID}, depositor string, recipient string, token string, amount {RAW}, transaction_id string, log_index int, timestamp {TS}", ("chain_id", "transaction_id", "log_index")),
    "chain_balance_withdrawals": (f"{_ID}, user string, token string, amount {RAW}, withdrawal_type string, transaction_id string, log_index int, timestamp {TS}", ("chain_id", "transaction_id", "log_index")),
    "chain_balance_unlocks": (f"{_ID}, user string, token string, amount {RAW}, transaction_id string, log_index int, timestamp {TS}", ("chain_id", "transaction_id", "log_index")),
    "chain_balance_token_whitelist": (f"{_ID}, token string, is_whitelisted boolean, action string, transaction_id string, log_index int, timestamp {TS}", ("chain_id", "transaction_id", "log_index")),
    "chain_balance_states": (f"{_ID}, user string, token string, balance {RAW}, unlocked_balance {RAW}, last_updated {TS}", ("chain_id", "user", "token")),
    "token_mappings": (f"id string, source_chain_id int, source_token string, target_chain_id int, synthetic_token string, symbol string, source_decimals int, synthetic_decimals int, is_active boolean, registered_at {TS}", ("source_chain_id", "source_token", "target_chain_id")),
    "users": (f"{_ID}, address string, first_seen_timestamp {TS}, last_seen_timestamp {TS}, total_orders bigint, total_deposits bigint, total_volume {RAW}", ("chain_id", "address")),
    "deposits": (f"{_ID}, user string, currency string, amount {RAW}, timestamp {TS}, transaction_id string, block_number bigint", ("transaction_id", "currency")),
    "withdrawals": (f"{_ID}, user string, currency string, amount {RAW}, timestamp {TS}, transaction_id string, block_number bigint", ("transaction_id", "currency")),
    "lending_positions": (f"{_ID}, user string, collateral_token string, debt_token string, collateral_amount {RAW}, debt_amount {RAW}, health_factor int, last_updated {TS}, is_active boolean", ("id",)),
    "lending_events": (f"{_ID}, user string, action string, token string, amount {RAW}, debt_token string, liquidator string, interest_rate int, timestamp {TS}, transaction_id string, block_number bigint", ("id",)),
    "synthetic_tokens": (f"{_ID}, address string, symbol string, total_supply {RAW}, timestamp {TS}", ("id",)),
    "yield_accruals": (f"{_ID}, user string, token string, yield_type string, amount {RAW}, timestamp {TS}", ("id",)),
    "liquidations": (f"{_ID}, liquidated_user string, liquidator string, collateral_token string, debt_token string, debt_to_cover {RAW}, liquidation_bonus int, timestamp {TS}, transaction_id string", ("id",)),
    "oracle_prices": (f"{_ID}, token string, price {RAW}, decimals int, source string, timestamp {TS}", ("chain_id", "token", "timestamp")),
    "asset_configurations": (f"{_ID}, token string, collateral_factor int, liquidation_threshold int, liquidation_bonus int, reserve_factor int, timestamp {TS}, is_active boolean", ("chain_id", "token")),
    "user_lending_stats": (f"{_ID}, user string, total_supplied {RAW}, total_borrowed {RAW}, total_repaid {RAW}, total_withdrawn {RAW}, total_liquidations bigint, total_liquidated_amount {RAW}, first_activity {TS}, last_activity {TS}", ("chain_id", "user")),
    "pool_lending_stats": (f"{_ID}, pool_id string, token string, total_supply {RAW}, total_borrow {RAW}, supply_rate int, borrow_rate double, utilization_rate int, last_updated {TS}", ("chain_id", "token")),
    "positions": (f"user_id string, symbol string, quantity double, avg_cost double, total_cost double, realized_pnl double, unrealized_pnl double, updated_at {TS}", ("user_id", "symbol")),
    "portfolio_snapshots": (f"snapshot_ts {TS}, user_id string, total_value double, positions string", ("snapshot_ts", "user_id")),
    "hourly_pnl_metrics": (f"bucket {TS}, user_id string, total_pnl double, total_realized_pnl double, total_unrealized_pnl double, trades_count bigint, volume_traded double", ("bucket", "user_id")),
    "liquidity_snapshots": (f"snapshot_ts {TS}, pool_id string, symbol string, side string, price double, quantity {RAW}, order_count bigint, liquidity_value double, interval_type string", ("snapshot_ts", "pool_id", "side", "price", "interval_type")),
    "liquidity_snapshots_aggregated": (f"snapshot_ts {TS}, pool_id string, symbol string, bid_liquidity double, ask_liquidity double, total_liquidity double, bid_orders bigint, ask_orders bigint, best_bid double, best_ask double, spread double, interval_type string", ("snapshot_ts", "pool_id", "interval_type")),
    "trade_aggregates": (f"timestamp {TS}, symbol string, volume double, trade_count bigint, avg_price double, high_price double, low_price double", ("timestamp", "symbol")),
    "sync_log": (f"trade_id string, service string, status string, processed_at {TS}, error_message string", ("trade_id", "service")),
    "startup_data_jobs": (f"job_name string, status string, started_at {TS}, completed_at {TS}, records_processed bigint, error_message string", ("job_name", "started_at")),
    "leaderboard_snapshots": (f"board string, period string, user_id string, rank bigint, value double, ts {TS}", ("board", "period", "user_id", "ts")),
    "analytics_retry_queue": ("topic string, payload string, error string, retry_count int, first_failed_at bigint", ("topic", "payload")),
    "user_trading_stats": (f"user_id string, total_trades bigint, total_volume double, last_trade_at {TS}", ("user_id",)),
    "market_sentiment_history": (f"timestamp {TS}, symbol string, sentiment double, payload string", ("timestamp", "symbol")),
    "performance_metrics": (f"timestamp {TS}, metric string, value double", ("timestamp", "metric")),
    "leaderboard_metadata": (f"board string, period string, last_updated {TS}, total_users bigint", ("board", "period")),
}

# Accepted words of the enum-like text columns.
ENUMS = {
    "side": ["Buy", "Sell"], "type": ["Limit", "Market"],
    "status": ["OPEN", "PARTIALLY_FILLED", "FILLED", "CANCELLED", "REJECTED", "EXPIRED"],
    "action": ["SUPPLY", "BORROW", "REPAY", "WITHDRAW", "LIQUIDATE"], "yield_type": ["LENDING", "BORROWING"],
    "source": ["CHAINLINK", "TWAP", "MANUAL"],
}


def empty_table(spark, name: str):
    """An empty state table with its declared schema."""
    return spark.createDataFrame([], STATE_TABLES[name][0])
