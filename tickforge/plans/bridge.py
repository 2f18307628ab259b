"""Cross-chain messages, transfers, token registry and faucet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.operators.keyed import (
    first_per_key, last_non_null_per_key, latest_per_key, top_per_group, upsert_coalesce,
)


def bridge_messages(events: DataFrame) -> DataFrame:
    """Message log keyed by (message, type); the first write wins."""
    return first_per_key(events, ["message_id", "type"], "seq")


def bridge_links(messages: DataFrame) -> DataFrame:
    """Dispatch paired with process: SENT until the process side is seen, then RELAYED."""
    half = lambda kind, p: messages.filter(F.col("type") == kind).select(
        "message_id", F.col("chain_id").alias(f"{p}_chain"), F.col("tx_hash").alias(f"{p}_tx"), F.col("ts").alias(f"{p}_ts"))
    both = upsert_coalesce(half("DISPATCH", "source"), half("PROCESS", "target"), ["message_id"])
    return both.withColumn("status", F.when(F.col("target_tx").isNotNull(), "RELAYED").otherwise("SENT"))


def bridge_transfers(deposits: DataFrame, messages: DataFrame) -> DataFrame:
    """Deposit and dispatch of one source transaction merged; PENDING until dispatched."""
    sent = messages.filter(F.col("type") == "DISPATCH").select("tx_hash", "message_id", F.col("ts").alias("sent_at"))
    d = deposits.select("tx_hash", "deposit_id", "user_id", "token", "amount", "ts")
    return d.join(sent, "tx_hash", "full_outer").select(
        "tx_hash", "deposit_id", "message_id", "user_id", "token", "amount", F.coalesce("ts", "sent_at").alias("ts"),
        F.when(F.col("message_id").isNotNull(), "SENT").otherwise("PENDING").alias("status"))


def bridge_deposit_status(deposits: DataFrame, messages: DataFrame, status: str | None = None,
                          limit: int = 50) -> DataFrame:
    """Newest deposits per user with both message halves; the status filter runs before the limit."""
    sent = messages.filter(F.col("type") == "DISPATCH").select(
        "tx_hash", "message_id", F.struct(F.col("chain_id"), F.col("ts")).alias("dispatch"))
    done = messages.filter(F.col("type") == "PROCESS").select(
        "message_id", F.struct(F.col("chain_id"), F.col("tx_hash"), F.col("ts")).alias("process"))
    joined = deposits.join(sent, "tx_hash", "left").join(done, "message_id", "left").withColumn(
        "status", F.when(F.col("process").isNotNull(), "RELAYED").when(F.col("dispatch").isNotNull(), "SENT")
        .otherwise("PENDING"))
    if status is not None:
        joined = joined.filter(F.col("status") == status)
    return top_per_group(joined, ["user_id"], [F.col("ts").desc(), F.col("seq").desc()], limit).select(
        "user_id", "deposit_id", "token", "amount", "tx_hash", "message_id", "status", "ts", "dispatch", "process")


def token_mapping_state(events: DataFrame, excluded_chains: list[int] = ()) -> DataFrame:
    """Current mapping per (source chain, source token, target chain).

    Registration, synthetic updates and deactivation are ignored for excluded source chains; a status
    toggle always applies. Mappings never registered or updated are not created by a toggle.
    """
    kept = events.filter(~F.col("source_chain").isin(list(excluded_chains)) | (F.col("op") == "toggle")) \
        if excluded_chains else events
    keys = ["source_chain", "source_token", "target_chain"]
    state = last_non_null_per_key(kept, keys, "seq", ["synthetic_token", "symbol", "source_decimals", "is_active"])
    last = kept.groupBy(*keys).agg(F.max("seq").alias("seq"))
    return state.join(last, keys).filter(F.col("synthetic_token").isNotNull())


def currencies_from_mappings(mappings: DataFrame) -> DataFrame:
    """Underlying and synthetic currency row per mapping, newest per (chain, address)."""
    one = lambda chain, addr, sym, kind: F.struct(
        F.col(chain).alias("chain_id"), F.lower(addr).alias("address"), sym.alias("symbol"), F.lit(kind).alias("token_type"))
    sym = F.coalesce("symbol", F.lit("UNKNOWN"))
    rows = mappings.select("seq", F.coalesce("source_decimals", F.lit(18)).alias("decimals"), "is_active", F.explode(F.array(
        one("source_chain", "source_token", sym, "underlying"),
        one("target_chain", "synthetic_token", F.concat(F.lit("gs"), sym), "synthetic"))).alias("c"))
    flat = rows.select("c.*", "decimals", "is_active", "seq")
    return latest_per_key(flat, ["chain_id", "address"], "seq")


def token_mappings(mappings: DataFrame, source_chain: int | None = None, target_chain: int | None = None,
                   symbol: str | None = None, active: bool | None = None, limit: int = 100) -> DataFrame:
    """Newest mappings under optional filters."""
    checks: list[Column] = []
    if source_chain is not None:
        checks.append(F.col("source_chain") == source_chain)
    if target_chain is not None:
        checks.append(F.col("target_chain") == target_chain)
    if symbol is not None:
        checks.append(F.col("symbol") == symbol)
    if active is not None:
        checks.append(F.col("is_active") == active)
    out = mappings
    for c in checks:
        out = out.filter(c)
    return out.orderBy(F.col("seq").desc()).limit(limit)


def token_info(addresses: DataFrame, currencies: DataFrame) -> DataFrame:
    """Symbol, name and decimals per address and chain with defaults for unknown tokens."""
    info = currencies.select(F.lower("address").alias("address"), "chain_id", "symbol", "name", "decimals")
    return addresses.select(F.lower("address").alias("address"), "chain_id").distinct().join(
        info, ["address", "chain_id"], "left").select(
        "address", "chain_id", F.coalesce("symbol", F.lit("UNKNOWN")).alias("symbol"),
        F.coalesce("name", F.lit("Unknown Token")).alias("name"), F.coalesce("decimals", F.lit(18)).alias("decimals"))


def currencies_list(currencies: DataFrame, limit: int = 50, offset: int = 0, chain_id: int | None = None,
                    token_type: str | None = None, active_only: bool = True) -> DataFrame:
    """One page of currencies by symbol, with the total number that match."""
    c = currencies
    if chain_id is not None:
        c = c.filter(F.col("chain_id") == chain_id)
    if token_type is not None:
        c = c.filter(F.col("token_type") == token_type)
    if active_only:
        c = c.filter("is_active")
    total = c.agg(F.count(F.lit(1))).scalar()
    return c.orderBy("symbol", "address").offset(offset).limit(limit).withColumn("total", total)


def currency_by_address(currencies: DataFrame, address: str, chain_id: int | None = None) -> DataFrame:
    c = currencies.filter(F.lower("address") == address.lower())
    return c if chain_id is None else c.filter(F.col("chain_id") == chain_id)


def faucet_request_state(events: DataFrame) -> DataFrame:
    """Request lifecycle: per column the last non-null value."""
    state = last_non_null_per_key(events, ["request_id"], "seq", ["address", "chain_id", "status", "tx_hash", "error"])
    times = events.groupBy("request_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("updated_at"))
    return state.join(times, "request_id")


def faucet_history(requests: DataFrame, address: str | None = None, chain_id: int | None = None,
                   limit: int = 50) -> DataFrame:
    """Oldest requests first, address compared without case."""
    q = requests
    if address is not None:
        q = q.filter(F.lower("address") == address.lower())
    if chain_id is not None:
        q = q.filter(F.col("chain_id") == chain_id)
    return q.orderBy("created_at", "request_id").limit(limit)
