"""Streams with state of their own: order books, balances and rolling tickers that can run for ever.

State is kept per key and removed when the key is done (an order that closed, an account that is empty and idle, a symbol
without a trade for a day). What the streams emit goes to tables that are compacted as they grow.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tickforge.functions.columns import kind_of
from tickforge.operators.keyed import latest_per_key
from tickforge.plans.books import best_levels
from tickforge.plans.ledger import ledger_deltas
from tickforge.plans.orders import POOL, UPDATE_EVENTS, side_name, status_name
from tickforge.sources.tables import _folder

DAY, MINUTE = 86400, 60
COMPACT_EVERY = 8  # batches
ORDER_BLOCK = 1024  # order ids that share a call of the state
NO_ORDER = -(2**63)  # stands for a missing order id, which would make floats of all ids in pandas
ACCOUNT_BLOCKS = 4096  # calls of the state that users share


def with_state_store(spark: SparkSession) -> SparkSession:
    """Keyed state with timers needs the store on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


class _Keyed(StatefulProcessor):
    """One value per key; timers are moved, not added."""

    fields = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", self.fields)

    def wake(self, at: int) -> None:
        """One timer per key, at epoch seconds ``at``."""
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at * 1000)

    def close(self) -> None:
        pass


def _plain(value):
    """A column value as a Python number."""
    return value.item() if hasattr(value, "item") else value


class _Orders(_Keyed):
    """What each order adds to its level, as changes; a closed order leaves nothing behind.

    A key is a block of order ids, because a call per order costs far more than its few rows; inside it every order has a
    state row of its own. Events of an order that is not known (closed already, or not placed yet) wait for ``patience`` seconds.
    """

    def __init__(self, kind: str, patience: int):
        self.fields = f"side int, price {kind}, placed {kind}, matched {kind}, ended boolean, at bigint"
        self.patience = patience

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getMapState("orders", "pool_id string, order_id bigint", self.fields)

    @staticmethod
    def _adds(side, price, placed, matched, ended, at=0):
        if placed is None or ended or placed - matched <= 0:
            return 0, 0
        return placed - matched, 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {tuple(k): tuple(v) for k, v in self.state.iterator()}
        now: dict[tuple, list] = {}
        for pdf in rows:
            for pool, oid, kind, side_code, p, q, ends, ts in zip(*[pdf[c].tolist() for c in (
                    "pool_id", "order_id", "kind", "side_code", "price", "quantity", "ends", "ts")], strict=True):
                order = now.get((pool, oid))
                if order is None:
                    order = now[pool, oid] = [*held.get((pool, oid), (None, None, None, 0, False))[:5], 0]
                if kind == "OrderPlaced":
                    order[:3] = side_code, p, q
                elif kind == "OrderMatched":
                    order[3] += q
                order[4], order[5] = bool(order[4] or ends), max(order[5], ts)
        changes = []
        for (pool, oid), order in now.items():
            old = held.get((pool, oid))
            before, after = self._adds(*old) if old else (0, 0), self._adds(*order)
            if order[2] is None or after != (0, 0):
                self.state.updateValue((pool, oid), tuple(order))
            elif old:
                self.state.removeKey((pool, oid))
            if order[2] is not None and before != after:
                changes.append((key[0], pool, order[0], order[1], after[0] - before[0], after[1] - before[1], order[5]))
        if any(order[2] is None for order in now.values()):
            self._wait(v for v in (held | now).values())
        if changes:
            yield pd.DataFrame(changes, columns=["chain_id", "pool_id", "side_code", "price", "d_qty", "d_count", "last_updated"])

    def _wait(self, orders) -> None:
        """Wake the block when the first of its unknown orders has waited long enough."""
        unknown = [order[5] for order in orders if order[2] is None]
        if unknown:
            self.wake(min(unknown) + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = {tuple(k): tuple(v) for k, v in self.state.iterator()}
        gone = [k for k, v in held.items() if v[2] is None and (v[5] + self.patience) * 1000 <= timerValues.getCurrentWatermarkInMs()]
        for k in gone:
            self.state.removeKey(k)
            del held[k]
        self._wait(held.values())
        return iter(())


def stream_depth(log: DataFrame, watermark: str = "10 minutes", patience: int = 3600) -> DataFrame:
    """Changes (quantity, orders) of the levels, from open orders kept in state. ``log`` is an event log stream."""
    with_state_store(log.sparkSession)
    ev, kind = F.col("event_name"), kind_of(log, "quantity").simpleString()
    rows = log.filter(ev.isin("OrderPlaced", "OrderMatched", *UPDATE_EVENTS)).withColumn("event_time", F.timestamp_seconds("block_timestamp")).withWatermark(
        "event_time", watermark).select(
        "chain_id", F.col("address").alias("pool_id"), F.explode(F.when(ev == "OrderMatched", F.array("buy_order_id", "sell_order_id")).otherwise(
            F.array("order_id"))).alias("order_id"), ev.alias("kind"), *[F.coalesce(c, F.lit(0).cast(kind_of(log, c))).alias(c) for c in (
            "side_code", "price", "quantity")],  # a null would make floats of them in pandas
        F.coalesce(ev.isin(UPDATE_EVENTS) & status_name("status_code").isin("CANCELLED", "EXPIRED", "REJECTED"), F.lit(False)).alias("ends"),
        F.col("block_timestamp").alias("ts"), "event_time").withColumn("order_id", F.coalesce("order_id", F.lit(NO_ORDER)))
    out = rows.withColumn("block", F.floor(F.col("order_id") / ORDER_BLOCK)).groupBy("chain_id", "block").transformWithStateInPandas(
        _Orders(kind, patience), f"chain_id int, pool_id string, side_code int, price {kind}, d_qty {kind}, d_count int, last_updated bigint",
        "Append", "EventTime")
    return out.select("chain_id", "pool_id", side_name("side_code").alias("side"), "price", "d_qty", "d_count", "last_updated")


def merge_levels(changes: DataFrame) -> DataFrame:
    """Summed changes per level; levels that are empty again go."""
    return changes.groupBy(*POOL, "side", "price").agg(F.sum("d_qty").cast(kind_of(changes, "d_qty")).alias("d_qty"), F.sum("d_count").cast("int").alias("d_count"),
                                                       F.max("last_updated").alias("last_updated")).filter("d_qty <> 0 or d_count <> 0")


def read_depth(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """The book from the sink of ``stream_depth``, optionally the best levels per side."""
    levels = read_merged(spark, path, merge_levels).select(
        *POOL, "side", "price", F.col("d_qty").alias("quantity"), F.col("d_count").cast("long").alias("order_count")).filter("quantity > 0")
    return levels if limit is None else best_levels(levels, limit)


class _Accounts(_Keyed):
    """Running free and locked amount; an account that holds nothing is forgotten ``idle`` seconds after its last move.

    A key is a block of users; every account in it has a state row of its own.
    """

    def __init__(self, kind: str, idle: int):
        self.fields = f"available {kind}, locked {kind}, at bigint"
        self.idle = idle

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getMapState("accounts", "user_id string, currency string", self.fields)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = {tuple(k): tuple(v) for k, v in self.state.iterator()}
        now: dict[tuple, list] = {}
        for pdf in rows:
            for user, currency, amount, locked, ts in zip(*[pdf[c].tolist() for c in ("user_id", "currency", "d_amount", "d_locked", "ts")], strict=True):
                account = now.get((user, currency))
                if account is None:
                    account = now[user, currency] = list(held.get((user, currency), (0, 0, 0)))
                account[0], account[1], account[2] = account[0] + amount, account[1] + locked, max(account[2], ts)
        for k, account in now.items():
            self.state.updateValue(k, tuple(account))
        if any(account[0] == 0 and account[1] == 0 for account in now.values()):
            self._wait((held | now).values())
        yield pd.DataFrame([(key[0], *k, *account) for k, account in now.items()], columns=["chain_id", "user_id", "currency", "available", "locked", "timestamp"])

    def _wait(self, accounts) -> None:
        """Wake the block when the first of its empty accounts has been idle long enough."""
        empty = [at for available, locked, at in accounts if available == 0 and locked == 0]
        if empty:
            self.wake(min(empty) + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = {tuple(k): tuple(v) for k, v in self.state.iterator()}
        for k, (available, locked, at) in list(held.items()):
            if available == 0 and locked == 0 and timerValues.getCurrentWatermarkInMs() >= (at + self.idle) * 1000:
                self.state.removeKey(k)
                del held[k]
        self._wait(held.values())
        return iter(())


def stream_balances(ledger: DataFrame, watermark: str = "10 minutes", idle: int = DAY, blocks: int = ACCOUNT_BLOCKS) -> DataFrame:
    """Free and locked amount of every account that moved."""
    with_state_store(ledger.sparkSession)
    kind = kind_of(ledger, "amount").simpleString()
    moves = ledger_deltas(ledger).withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", watermark).select(
        "chain_id", F.pmod(F.xxhash64("user_id"), F.lit(blocks)).alias("block"), "user_id", "currency",
        *[F.coalesce(c, F.lit(0).cast(kind)).alias(c) for c in ("d_amount", "d_locked")], "ts", "event_time")
    return moves.groupBy("chain_id", "block").transformWithStateInPandas(
        _Accounts(kind, idle), f"chain_id int, user_id string, currency string, available {kind}, locked {kind}, timestamp bigint", "Append", "EventTime")


def merge_balances(rows: DataFrame) -> DataFrame:
    """The last row of every account."""
    return latest_per_key(rows, ["chain_id", "user_id", "currency"], "_batch")


def _extremes(values: np.ndarray, low: np.ndarray, high: np.ndarray, pick) -> np.ndarray:
    """pick over values[low:high] for many ranges, from tables of ranges whose length is a power of two."""
    tables = [values]
    while 2 << len(tables) - 1 <= len(values):
        half = 1 << len(tables) - 1
        tables.append(pick(tables[-1][:-half], tables[-1][half:]))
    level = np.floor(np.log2(high - low)).astype(int)
    out = np.empty(len(low))
    for k in np.unique(level):
        at = level == k
        out[at] = pick(tables[k][low[at]], tables[k][high[at] - (1 << k)])
    return out


class _Ticker(_Keyed):
    """The minutes of the last day per key, and a ticker for every minute that the watermark has passed.

    ``told``: the last minute told. Without a minute in the day before it, a key is forgotten.
    """

    fields = "minute array<bigint>, close array<double>, high array<double>, low array<double>, volume array<double>, n array<bigint>, told bigint"
    columns = ("minute", "close", "high", "low", "volume", "n")

    def _tell(self, key, held: dict[str, np.ndarray], told: int, now: int) -> pd.DataFrame:
        minute = held["minute"]
        as_of = np.arange(told + MINUTE, now + 1, MINUTE)
        low, high = np.searchsorted(minute, as_of - DAY), np.searchsorted(minute, as_of)
        some = high > low
        as_of, low, high = as_of[some], low[some], high[some]
        upto = {c: np.concatenate([[0], np.cumsum(held[c])]) for c in ("volume", "n")}
        out = pd.DataFrame({"chain_id": np.full(len(as_of), key[0]), "symbol": [key[1]] * len(as_of), "as_of": as_of, "close": held["close"][high - 1],
                            "high": _extremes(held["high"], low, high, np.maximum), "low": _extremes(held["low"], low, high, np.minimum),
                            "volume": upto["volume"][high] - upto["volume"][low], "trade_count": upto["n"][high] - upto["n"][low]})
        kept = minute >= now + MINUTE - DAY
        if kept.any():
            self.state.update((*([_plain(x) for x in held[c][kept]] for c in self.columns), now))
            self.wake(now + MINUTE)
        else:
            self.state.clear()
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).sort_values("minute")
        new = {c: fresh[c].to_numpy() for c in self.columns}
        told = int(new["minute"][0])
        if self.state.exists():
            *old, told = self.state.get()
            new = {c: np.concatenate([np.array(o, new[c].dtype), new[c]]) for c, o in zip(self.columns, old, strict=True)}
        now = timerValues.getCurrentWatermarkInMs() // 1000 // MINUTE * MINUTE
        yield self._tell(key, new, told, max(now, told))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            *old, told = self.state.get()
            held = {c: np.array(o) for c, o in zip(self.columns, old, strict=True)}
            now = timerValues.getCurrentWatermarkInMs() // 1000 // MINUTE * MINUTE
            if now > told:
                yield self._tell(key, held, told, now)


def stream_mini_ticker(trades: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """Close, high, low, volume and trades of the 24 hours before every minute, per chain and symbol.

    Trades become one-minute rows by a windowed aggregation; a second stateful step keeps a day of those per key and tells a
    row for each minute as the watermark passes it, also for minutes without trades. It holds 1,440 rows per key.
    """
    with_state_store(trades.sparkSession)
    timed = trades.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", watermark)
    minutes = timed.groupBy(F.window("event_time", "1 minute"), "chain_id", "symbol").agg(
        F.max_by("price", "seq").alias("close"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("quantity").alias("volume"),
        F.count(F.lit(1)).alias("n"))
    rows = minutes.select("chain_id", "symbol", F.unix_timestamp("window.start").alias("minute"), "close", "high", "low", "volume", "n",
                          F.window_time("window").alias("event_time"))
    return rows.groupBy("chain_id", "symbol").transformWithStateInPandas(
        _Ticker(), "chain_id int, symbol string, as_of bigint, close double, high double, low double, volume double, trade_count bigint", "Append", "EventTime")


# --- compacted sinks -----------------------------------------------------------------------------
def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Batch numbers of the complete folders under ``path``."""
    folder, files = _folder(spark, path)
    if not files.exists(folder):
        return []
    names = [s.getPath().getName() for s in files.listStatus(folder)]
    done = [n for n in names if files.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[0])]
    return sorted(int(n.split("=")[1]) for n in done)


def _parts(spark: SparkSession, path: str) -> tuple[list[str], int]:
    """Folders that make up the table: the newest base and the batches after it; and the base's number."""
    bases = _numbers(spark, f"{path}/base")
    upto = bases[-1] if bases else -1
    changes = [f"{path}/change/batch={n}" for n in _numbers(spark, f"{path}/change") if n > upto]
    return ([f"{path}/base/upto={upto}"] if bases else []) + changes, upto


def merged_sink(path: str, merge: Callable[[DataFrame], DataFrame], every: int = COMPACT_EVERY) -> Callable[[DataFrame, int], None]:
    """Batch writer: merged changes per batch, and after every ``every`` batches one base table instead of all before.

    A replayed batch overwrites itself, or is skipped if a base holds it already; what a base replaces is deleted only
    after the base is complete.
    """
    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if _parts(spark, path)[1] >= n:
            return
        merge(batch.withColumn("_batch", F.lit(n).cast("long"))).write.mode("overwrite").parquet(f"{path}/change/batch={n}")
        if (n + 1) % every:
            return
        parts, upto = _parts(spark, path)
        merge(spark.read.parquet(*parts)).write.mode("overwrite").parquet(f"{path}/base/upto={n}")
        for old in [f"{path}/base/upto={upto}", *(f"{path}/change/batch={k}" for k in _numbers(spark, f"{path}/change") if k <= n)]:
            folder, files = _folder(spark, old)
            files.delete(folder, True)
    return write


def read_merged(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return merge(spark.read.parquet(*_parts(spark, path)[0]))


