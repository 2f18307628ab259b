"""Order-book event log to orders, fills, order history, pools and users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.functions.columns import kind_of, mul_div_floor, row_key
from tickforge.operators.keyed import first_per_key

# Order status names by on-chain code.
ORDER_STATUS = ["OPEN", "PARTIALLY_FILLED", "FILLED", "CANCELLED", "REJECTED", "EXPIRED"]
OPEN_STATUSES = ["NEW", "OPEN", "PARTIALLY_FILLED"]
UPDATE_EVENTS = ["OrderCancelled", "UpdateOrder"]
POOL = ["chain_id", "pool_id"]  # chains reuse pool addresses and order ids, and their event order is not comparable
ORDER = [*POOL, "order_id"]


def status_name(code: str | Column, names: list[str] | None = None) -> Column:
    """Status code to name; the code list differs between indexers, so it can be passed in."""
    c = F.col(code) if isinstance(code, str) else code
    return F.get(F.array(*[F.lit(n) for n in (names or ORDER_STATUS)]), c)


def side_name(code: str | Column) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    return F.when(c == 1, "Sell").otherwise("Buy")


def fold_orders_placed(log: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Order-placed events as order rows."""
    return log.filter(F.col("event_name") == "OrderPlaced").select(
        "chain_id", F.col("address").alias("pool_id"), "order_id", "user_id",
        side_name("side_code").alias("side"), "price", "quantity",
        F.when(F.col("is_market"), "Market").otherwise("Limit").alias("type"),
        status_name("status_code", names).alias("status"), F.col("block_timestamp").alias("ts"), "seq",
    )


def fills(log: DataFrame) -> DataFrame:
    """One row per match event."""
    return log.filter(F.col("event_name") == "OrderMatched").select(
        row_key("chain_id", "tx_hash", "buy_order_id", "sell_order_id").alias("fill_id"), "chain_id",
        F.col("address").alias("pool_id"), "buy_order_id", "sell_order_id", F.col("user_id").alias("taker"),
        side_name("side_code").alias("side"), "price", "quantity", F.col("block_timestamp").alias("ts"),
        "block_number", "log_index", "tx_hash", "seq",
    )


def explode_fills(log: DataFrame) -> DataFrame:
    """Two rows per fill, one for each order side; the side that did not take is the maker."""
    sides = F.explode(F.array(
        F.struct(F.lit("Buy").alias("side"), F.col("buy_order_id").alias("order_id")),
        F.struct(F.lit("Sell").alias("side"), F.col("sell_order_id").alias("order_id")),
    ))
    return (
        fills(log).withColumnRenamed("side", "taker_side").withColumn("x", sides)
        .select("fill_id", "chain_id", "pool_id", "x.side", "x.order_id",
                (F.col("x.side") != F.col("taker_side")).alias("is_maker"), "price", "quantity", "ts",
                "block_number", "log_index", "tx_hash", "seq")
    )


def order_fill_progress(orders: DataFrame, order_trades: DataFrame) -> DataFrame:
    """Filled quantity and the status it implies, before any cancel or update."""
    filled = order_trades.groupBy(*ORDER).agg(F.sum("quantity").alias("filled"))
    return orders.join(filled, ORDER, "left").select(
        *ORDER, "quantity", F.coalesce("filled", F.lit(0)).cast(kind_of(orders, "quantity")).alias("filled"),
        F.when(F.col("filled").isNull(), F.col("status"))
        .when(F.col("filled") == F.col("quantity"), "FILLED").otherwise("PARTIALLY_FILLED").alias("status"),
    )


def order_status_updates(log: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Latest cancel or update per order."""
    last = log.filter(F.col("event_name").isin(UPDATE_EVENTS)).groupBy(
        "chain_id", F.col("address").alias("pool_id"), "order_id"
    ).agg(F.max_by("status_code", "seq").alias("code"), F.max_by("block_timestamp", "seq").alias("ts"))
    return last.select(*ORDER, status_name("code", names).alias("status"), "ts")


def order_current_state(log: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Placed, filled and updated in one pass: typed deltas, one aggregation per order."""
    ev = F.col("event_name")
    deltas = (
        log.filter(ev.isin("OrderPlaced", "OrderMatched", *UPDATE_EVENTS))
        .withColumn("oid", F.explode(
            F.when(ev == "OrderMatched", F.array("buy_order_id", "sell_order_id")).otherwise(F.array("order_id"))))
        .select(
            F.col("address").alias("pool_id"), F.col("oid").alias("order_id"), "seq",
            (ev == "OrderPlaced").alias("placed"), (ev == "OrderMatched").alias("matched"),
            ev.isin(UPDATE_EVENTS).alias("updated"), "chain_id", "user_id", "side_code", "price", "quantity",
            "is_market", "status_code", "block_timestamp",
        )
    )
    at_place = lambda c: F.max(F.when(F.col("placed"), F.col(c)))
    upd_seq = F.when(F.col("updated"), F.col("seq"))
    state = deltas.groupBy(*ORDER).agg(
        at_place("user_id").alias("user_id"),
        at_place("side_code").alias("side_code"), at_place("price").alias("price"),
        at_place("quantity").alias("quantity"), at_place("is_market").alias("is_market"),
        at_place("status_code").alias("placed_code"), at_place("block_timestamp").alias("placed_at"),
        at_place("seq").alias("seq"),
        F.sum(F.when(F.col("matched"), F.col("quantity"))).alias("filled"),
        F.max(F.when(F.col("matched"), F.col("seq"))).alias("fill_seq"),
        F.max_by("status_code", upd_seq).alias("code"), F.max_by("block_timestamp", upd_seq).alias("updated_at"),
        F.max(upd_seq).alias("upd_seq"),
    ).filter(F.col("seq").isNotNull())
    by_update = F.col("upd_seq").isNotNull() & (F.col("upd_seq") > F.coalesce("fill_seq", F.lit(-1)))
    return state.select(
        "chain_id", "pool_id", "order_id", "user_id", side_name("side_code").alias("side"), "price", "quantity",
        F.when(F.col("is_market"), "Market").otherwise("Limit").alias("type"),
        F.coalesce("filled", F.lit(0)).cast(kind_of(log, "quantity")).alias("filled"),
        F.when(by_update, status_name("code", names))
        .when(F.col("filled").isNotNull(),
              F.when(F.col("filled") == F.col("quantity"), "FILLED").otherwise("PARTIALLY_FILLED"))
        .otherwise(status_name("placed_code", names)).alias("status"),
        "placed_at", F.coalesce("updated_at", "placed_at").alias("ts"), "seq",
    )


def order_history_log(log: DataFrame, names: list[str] | None = None) -> DataFrame:
    """One row per (order, transaction, filled); a later write of the same key replaces it.

    Only numbers are picked, which one hash aggregation holds without a sort; codes get their names afterwards. Hashes in
    lower-case hexadecimal are shuffled as their bytes, other text as it is.
    """
    tx, plain = F.col("tx_hash"), F.coalesce(F.lower(F.hex(F.unhex("tx_hash"))) == F.col("tx_hash"), F.lit(False))
    keys = [*ORDER, F.when(plain, F.unhex(tx)).alias("_bytes"), F.when(~plain, tx).alias("_text"), "filled"]
    rows = log.filter(F.col("event_name").isin("OrderPlaced", *UPDATE_EVENTS)).select(
        "chain_id", F.col("address").alias("pool_id"), "order_id", "tx_hash", F.col("block_timestamp").alias("ts"),
        F.coalesce("filled", F.lit(0)).cast(kind_of(log, "quantity")).alias("filled"), "status_code", "seq",
    )
    last = rows.groupBy(*keys).agg(
        F.max_by("ts", "seq").alias("ts"), F.max_by("status_code", "seq").alias("code"), F.max("seq").alias("seq"))
    return last.select(*ORDER, F.coalesce("_text", F.lower(F.hex("_bytes"))).alias("tx_hash"), "ts", "filled", status_name("code", names).alias("status"), "seq")


def fold_pools(created: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pool-created events to the pool dimension; the first event per order book wins.

    ``created``: chain_id, order_book, base, quote, ts, seq. ``tokens``: chain_id, address, symbol, decimals.
    """
    t = tokens.select("chain_id", F.lower("address").alias("address"), "symbol", "decimals")
    b = t.select("chain_id", F.col("address").alias("base"), F.col("symbol").alias("base_symbol"),
                 F.col("decimals").alias("base_decimals"))
    q = t.select("chain_id", F.col("address").alias("quote"), F.col("symbol").alias("quote_symbol"),
                 F.col("decimals").alias("quote_decimals"))
    first = first_per_key(
        created.withColumn("base", F.lower("base")).withColumn("quote", F.lower("quote")),
        ["chain_id", "order_book"], "seq")
    return (
        first.join(b, ["chain_id", "base"], "left").join(q, ["chain_id", "quote"], "left")
        .select(
            row_key("chain_id", "order_book").alias("id"), "chain_id", "order_book", "base", "quote",
            F.concat_ws("/", F.coalesce("base_symbol", F.lit("UNKNOWN")), F.coalesce("quote_symbol", F.lit("UNKNOWN"))).alias("coin"),
            F.coalesce("base_decimals", F.lit(18)).alias("base_decimals"),
            F.coalesce("quote_decimals", F.lit(18)).alias("quote_decimals"),
            F.lit(0).cast("long").alias("price"), F.lit(0).cast("long").alias("volume"),
            F.lit(0).cast("long").alias("volume_in_quote"), F.col("ts").alias("timestamp"))
    )


def pool_running_stats(pools: DataFrame, fill_rows: DataFrame) -> DataFrame:
    """Last price, base volume and quote volume per pool; each quote term is floored like the chain does."""
    dims = pools.select("chain_id", F.col("order_book").alias("pool_id"), "coin", "base_decimals")
    terms = fill_rows.join(dims.select(*POOL, "base_decimals"), POOL).withColumn(
        "quote", mul_div_floor("quantity", "price", "base_decimals"))
    stats = terms.groupBy(*POOL).agg(
        F.max_by("price", "seq").alias("price"), F.sum("quantity").alias("volume"),
        F.sum("quote").alias("volume_in_quote"), F.max("ts").alias("timestamp"))
    return dims.drop("base_decimals").join(stats, POOL, "left").select(
        *POOL, "coin", F.coalesce("price", F.lit(0)).alias("price"),
        F.coalesce("volume", F.lit(0)).alias("volume"),
        F.coalesce("volume_in_quote", F.lit(0)).alias("volume_in_quote"), "timestamp")


def user_stats(log: DataFrame, ledger: DataFrame) -> DataFrame:
    """First and last activity, placed orders, deposits and raw traded volume (price x quantity) per user."""
    ev = F.col("event_name")
    placed = log.filter(ev.isin("OrderPlaced", "OrderMatched")).select(
        "chain_id", "user_id", F.col("block_timestamp").alias("ts"),
        (ev == "OrderPlaced").cast("long").alias("orders"), F.lit(0).cast("long").alias("deposits"),
        F.when(ev == "OrderMatched", F.col("price").cast("double") * F.col("quantity").cast("double")).otherwise(0.0).alias("volume"))
    moved = ledger.select(
        "chain_id", F.explode(F.when(F.col("op").startswith("transfer"), F.array("user_id", "receiver", "operator"))
                              .otherwise(F.array("user_id"))).alias("user_id"), "ts",
        F.lit(0).cast("long").alias("orders"), (F.col("op") == "deposit").cast("long").alias("deposits"),
        F.lit(0.0).alias("volume"))
    return placed.unionByName(moved).groupBy("chain_id", "user_id").agg(
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.sum("orders").alias("total_orders"),
        F.sum("deposits").alias("total_deposits"), F.sum("volume").alias("total_volume"))
