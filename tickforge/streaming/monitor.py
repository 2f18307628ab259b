"""Progress of streaming queries as a table, and how far each is behind its source."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tickforge.sources.tables import _folder

PROGRESS = "query string, run string, batch_id bigint, at string, input_rows bigint, rows_per_second double, state_rows bigint"


class ProgressLog(StreamingQueryListener):
    """Appends every progress event of the session's queries to a folder of JSON lines, one file per event.

    A query keeps only its last hundred events; the folder keeps all, over restarts too.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.ended: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {"query": p.name or str(p.id), "run": str(p.runId), "batch_id": int(p.batchId), "at": p.timestamp, "input_rows": int(p.numInputRows),
               "rows_per_second": float(p.processedRowsPerSecond or 0.0), "state_rows": sum(int(s.numRowsTotal) for s in p.stateOperators)}
        folder, files = _folder(self.spark, f"{self.path}/{row['run']}-{row['batch_id']:09d}-{uuid.uuid4().hex[:8]}.json")
        out = files.create(folder, True)
        out.write(bytearray(json.dumps(row) + "\n", "utf-8"))
        out.close()

    def onQueryTerminated(self, event) -> None:
        self.ended.add(str(event.runId))

    def wait_for(self, run: str, seconds: float = 30.0) -> None:
        """Events arrive after the fact; wait for the last of a run."""
        until = time.time() + seconds
        while run not in self.ended and time.time() < until:
            time.sleep(0.05)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """One row per query, run and batch, the newest where a batch reported more than once."""
    rows = spark.read.schema(PROGRESS).json(path)
    return rows.groupBy("query", "run", "batch_id").agg(F.max_by(F.struct("at", "input_rows", "rows_per_second", "state_rows"), F.struct("at", "input_rows")).alias("p")).select(
        "query", "run", "batch_id", "p.*")


def lag_report(progress: DataFrame, lengths: DataFrame, as_of: int) -> DataFrame:
    """Per query: batches, entries of its source (length), read and pending ones, speed, state, and seconds since it moved.

    ``lengths``: query and length, from the source itself.
    """
    p = progress.groupBy("query").agg(
        F.count(F.when(F.col("input_rows") > 0, 1)).alias("batches"), F.sum("input_rows").alias("read"),
        F.max_by("rows_per_second", F.when(F.col("input_rows") > 0, F.col("at"))).alias("rows_per_second"), F.max_by("state_rows", "at").alias("state_rows"),
        F.max(F.when(F.col("input_rows") > 0, F.to_timestamp("at"))).alias("moved"))
    return lengths.join(p, "query", "left").select(
        "query", "length", F.coalesce("batches", F.lit(0)).alias("batches"), F.coalesce("read", F.lit(0)).alias("read"),
        (F.col("length") - F.coalesce("read", F.lit(0))).alias("pending"), "rows_per_second", "state_rows",
        (F.lit(as_of) - F.unix_timestamp("moved")).alias("idle_seconds"))
