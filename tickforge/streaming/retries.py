"""Messages that cannot be used yet: kept with their error, tried again later, given up in the end.

A message is known by its id. Every attempt appends a row to the table of failures; the newest row of a message counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.operators.keyed import latest_per_key
from tickforge.sources.tables import read_table
from tickforge.streaming.streams import invalid_reason, stream_parse_route

MAX_ATTEMPTS, BACKOFF = 3, 60
FIELDS = "map<string,string>"


def with_id(raw: DataFrame) -> DataFrame:
    """Messages with ``message_id``: their own, or else a digest of topic and fields."""
    if "message_id" in raw.columns:
        return raw
    return raw.withColumn("message_id", F.sha2(F.to_json(F.struct("topic", "fields")), 256))


def _put(rows: DataFrame, path: str, batch: int) -> None:
    """Replace one batch of a table; the batches of retries are negative."""
    rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def _deliver(raw: DataFrame, kind: str, good_path: str, batch: int) -> None:
    """Typed records of messages that no other batch has delivered."""
    rows = stream_parse_route(raw, kind, "message_id").dropDuplicates(["message_id"])
    held = read_table(raw.sparkSession, good_path)
    if held is not None:
        rows = rows.join(held.filter(F.col("batch") != batch).select("message_id"), "message_id", "left_anti")
    _put(rows, good_path, batch)


def _failed(raw: DataFrame, bad_path: str, batch: int, attempts, now: int, max_attempts: int, backoff: int) -> None:
    rows = raw.withColumn("attempts", attempts)
    _put(rows.select("message_id", "topic", F.to_json("fields").alias("payload"), "error", "attempts",
                     (F.lit(now) + backoff * F.pow(F.lit(2), F.col("attempts") - 1)).cast("long").alias("next_attempt"),
                     F.when(F.col("attempts") >= max_attempts, "dead").otherwise("pending").alias("status")), bad_path, batch)


def quarantine(kind: str, required: tuple[str, ...], good_path: str, bad_path: str, now: int = 0, max_attempts: int = MAX_ATTEMPTS,
               backoff: int = BACKOFF) -> Callable[[DataFrame, int], None]:
    """Batch writer: typed records to one table, unusable messages with error and next attempt to another."""
    def write(batch: DataFrame, n: int) -> None:
        marked = with_id(batch).withColumn("error", invalid_reason(kind, required))
        _deliver(marked.filter("error is null"), kind, good_path, n)
        _failed(marked.filter("error is not null"), bad_path, n, F.lit(1), now, max_attempts, backoff)
    return write


def quarantined(spark: SparkSession, bad_path: str) -> DataFrame:
    """The last failure of every message, delivered since or not."""
    return latest_per_key(spark.read.parquet(bad_path).drop("batch"), ["message_id"], "attempts")


def retry(spark: SparkSession, kind: str, required: tuple[str, ...], good_path: str, bad_path: str, now: int, repair: Callable[[DataFrame], DataFrame] | None = None,
          max_attempts: int = MAX_ATTEMPTS, backoff: int = BACKOFF) -> dict[str, int]:
    """Try the messages that are due once more; ``repair`` may give them other fields.

    What can be used is delivered once, whatever is run again; the rest waits twice as long or, after ``max_attempts``, is
    dead and never tried again. The same ``now`` replaces its own results.
    """
    held = spark.read.parquet(bad_path).filter(F.col("batch") != -now).drop("batch")
    due = latest_per_key(held, ["message_id"], "attempts").filter((F.col("status") == "pending") & (F.col("next_attempt") <= now))
    delivered = spark.read.parquet(good_path).filter(F.col("batch") != -now).select("message_id")
    due = due.join(delivered, "message_id", "left_anti").withColumn("fields", F.from_json("payload", FIELDS)).select("message_id", "topic", "fields", "attempts")
    tried = (repair(due) if repair else due).withColumn("error", invalid_reason(kind, required))
    _deliver(tried.filter("error is null"), kind, good_path, -now)
    _failed(tried.filter("error is not null"), bad_path, -now, F.col("attempts") + 1, now, max_attempts, backoff)
    spent = spark.read.parquet(bad_path).filter(F.col("batch") == -now)
    return {"delivered": spark.read.parquet(good_path).filter(F.col("batch") == -now).count(), "waiting": spent.filter("status = 'pending'").count(),
            "dead": spent.filter("status = 'dead'").count()}
