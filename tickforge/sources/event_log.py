"""Event log and document readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.schemas import METRICS, STATIC_POOLS


def scan_events(log: DataFrame, event_names: list[str] | None = None, start_block: int | None = None,
                end_block: int | None = None, chain_id: int | None = None) -> DataFrame:
    """Log rows of some events in a block range; plain comparisons, so they prune files and row groups."""
    out = log
    if event_names:
        out = out.filter(F.col("event_name").isin(event_names))
    if start_block is not None:
        out = out.filter(F.col("block_number") >= start_block)
    if end_block is not None:
        out = out.filter(F.col("block_number") <= end_block)
    return out if chain_id is None else out.filter(F.col("chain_id") == chain_id)


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """Decoded log written by ``write_event_log``: one folder per event name."""
    return spark.read.parquet(path)


def write_event_log(log: DataFrame, path: str, files_per_day: int = 16) -> None:
    """Store the log by event name, sorted by block inside files so that block ranges skip row groups.

    Events of one kind and day are spread over up to ``files_per_day`` tasks and files.
    """
    spread = F.pmod(F.xxhash64("chain_id", "block_number", "log_index"), F.lit(files_per_day))
    log.repartition("event_name", F.floor(F.col("block_number") / 86400), spread).sortWithinPartitions(
        "event_name", "block_number", "log_index").write.mode("overwrite").partitionBy("event_name").parquet(path)


def factory_filter(log: DataFrame, pools: DataFrame) -> DataFrame:
    """Events of contracts that a pool-created event announced; addresses compared without case."""
    known = pools.select(F.lower("order_book").alias("_known")).distinct()
    return log.join(known, F.lower(log["address"]) == F.col("_known"), "left_semi")


def live_gate(log: DataFrame, min_block: int) -> DataFrame:
    """Only events at or after the block from which downstream topics are live."""
    return log.filter(F.col("block_number") >= min_block)


def static_pool_json(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Nested pools documents (one per file, or one per line) to a flat pool dimension."""
    doc = spark.read.schema(STATIC_POOLS).json(path, multiLine=multi_line)
    p = F.col("p")
    flat = {"id": "id", "chainId": "chain_id", "coin": "coin", "orderBook": "order_book", "baseDecimals": "base_decimals",
            "quoteDecimals": "quote_decimals", "price": "price", "volume": "volume", "volumeInQuote": "volume_in_quote",
            "timestamp": "timestamp"}
    side = lambda s: [F.lower(p[f"{s}Currency"]["address"]).alias(f"{s}_address"), p[f"{s}Currency"]["symbol"].alias(f"{s}_symbol"),
                      p[f"{s}Currency"]["name"].alias(f"{s}_name")]
    return doc.select(F.explode("data.poolss.items").alias("p")).select(
        *[p[k].alias(v) for k, v in flat.items()], *side("base"), *side("quote"))


def read_metrics_jsonl(spark: SparkSession, path: str, last: int | None = None) -> DataFrame:
    """Append-only metrics log, optionally its newest entries."""
    m = spark.read.schema(METRICS).json(path)
    return m if last is None else m.orderBy(F.col("ts").desc()).limit(last)


def scan_state_table(table: DataFrame, ts_col: str | None = None, from_ts: int | None = None) -> DataFrame:
    return table if from_ts is None else table.filter(F.col(ts_col) >= from_ts)
