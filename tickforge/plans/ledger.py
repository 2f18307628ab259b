"""Balance movements: additive ledger, running history, deposits, chain balances, whitelist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickforge.functions.columns import kind_of
from tickforge.operators.keyed import latest_per_key
from tickforge.operators.temporal import running_sums


def ledger_deltas(events: DataFrame) -> DataFrame:
    """One signed (amount, locked) movement per account touched by an event."""
    kind = kind_of(events, "amount")
    a, fee, zero = F.col("amount"), F.col("fee"), F.lit(0).cast(kind)
    move = lambda user, free, locked, leg: F.struct(
        F.col(user).alias("user_id"), free.cast(kind).alias("d_amount"), locked.cast(kind).alias("d_locked"),
        F.lit(leg).alias("leg"))
    op = F.col("op")
    received = [move("receiver", a - fee, zero, 1), move("operator", fee, zero, 2)]
    legs = (
        F.when(op == "deposit", F.array(move("user_id", a, zero, 0)))
        .when(op == "withdraw", F.array(move("user_id", -a, zero, 0)))
        .when(op == "lock", F.array(move("user_id", -a, a, 0)))
        .when(op == "unlock", F.array(move("user_id", a, -a, 0)))
        .when(op == "transfer", F.array(move("user_id", -a, zero, 0), *received))
        .when(op == "transfer_locked", F.array(move("user_id", zero, -a, 0), *received))
    )
    return events.select("chain_id", "currency", "ts", "block_number", "seq", F.explode(legs).alias("m")).select(
        "chain_id", "currency", "ts", "block_number", "seq", "m.*")


def balance_ledger(events: DataFrame) -> DataFrame:
    """Free and locked amount per account and currency: a pure sum, so replays are harmless."""
    return ledger_deltas(events).groupBy("chain_id", "user_id", "currency").agg(
        F.sum("d_amount").alias("amount"), F.sum("d_locked").alias("locked"), F.max("ts").alias("last_updated"))


def balance_history(events: DataFrame, partitions: int | None = None) -> DataFrame:
    """Balance after every movement. Accounts are cut by rows, so a hot account is many tasks."""
    d = ledger_deltas(events).withColumn("k", F.struct("seq", "leg"))
    out = running_sums(d, ["chain_id", "user_id", "currency"], "k", ["d_amount", "d_locked"], partitions=partitions)
    return out.select("chain_id", "user_id", "currency", "ts", "seq", "leg", "d_amount", "d_locked",
                      F.col("d_amount_after").alias("available"), F.col("d_locked_after").alias("locked"))


def keyed_log(events: DataFrame, op: str) -> DataFrame:
    """Deposit or withdrawal log keyed by (transaction, currency); a later write replaces."""
    rows = events.filter(F.col("op") == op).select(
        "chain_id", "tx_hash", "currency", "user_id", "amount", "ts", "block_number", "seq")
    return latest_per_key(rows, ["tx_hash", "currency"], "seq")


def account_balances(balances: DataFrame, currencies: DataFrame) -> DataFrame:
    """Free, locked and total per asset; unknown currencies keep their address."""
    c = currencies.select(F.lower("address").alias("_a"), "chain_id", "symbol", "decimals")
    b = balances.withColumn("_a", F.lower("currency"))
    return b.join(c, ["_a", "chain_id"], "left").select(
        "chain_id", "user_id", "currency", F.coalesce("symbol", F.lit("UNKNOWN")).alias("asset"),
        F.coalesce("decimals", F.lit(18)).alias("decimals"), F.greatest(F.col("amount"), F.lit(0)).alias("free"),
        F.greatest(F.col("locked"), F.lit(0)).alias("locked"))


def balances_total(balances: DataFrame) -> DataFrame:
    return balances.select("chain_id", "user_id", "currency", F.col("amount").alias("available"), "locked",
                           (F.col("amount") + F.col("locked")).alias("total"))


def chain_balance_state(events: DataFrame) -> DataFrame:
    """Deposited and unlocked amounts per account and token."""
    a, op = F.col("amount"), F.col("op")
    d = events.filter(op != "whitelist").select(
        "chain_id", "user_id", "token", "ts",
        F.when(op == "deposit", a).when(op.isin("withdraw", "unlock"), -a).otherwise(F.lit(0)).alias("db"),
        F.when(op == "unlock", a).when(op == "claim", -a).otherwise(F.lit(0)).alias("du"))
    return d.groupBy("chain_id", "user_id", "token").agg(
        F.sum("db").alias("balance"), F.sum("du").alias("unlocked"), F.max("ts").alias("last_updated"))


def chain_balance_logs(events: DataFrame) -> DataFrame:
    """Deposit, withdrawal (withdraw or claim) and unlock logs in one frame with a kind column."""
    op = F.col("op")
    return events.filter(op != "whitelist").select(
        F.when(op == "deposit", "deposit").when(op == "unlock", "unlock").otherwise("withdrawal").alias("log"),
        F.when(op.isin("withdraw", "claim"), op).alias("withdrawal_type"), "chain_id", "user_id", "token", "amount",
        "tx_hash", "log_index", "ts")


def token_whitelist(events: DataFrame) -> DataFrame:
    """Current whitelist flag per token from the add/remove log."""
    return events.filter(F.col("op") == "whitelist").groupBy("chain_id", "token").agg(
        F.max_by("is_whitelisted", "seq").alias("is_whitelisted"), F.max("ts").alias("last_updated"),
        F.count(F.lit(1)).alias("changes"))
