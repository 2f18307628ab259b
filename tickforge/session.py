"""Session helpers: settings the library relies on and the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tickforge", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings every job here expects (UTC, AQE with skew handling)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    return pin_utc(b.getOrCreate())


def pin_utc(spark: SparkSession) -> SparkSession:
    """Epoch arithmetic assumes a UTC session."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a session that runs in one process may leave it unset and gets a temporary folder; on a cluster the
    executors could not see that, so it is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return configured or current
    if not configured and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    target = configured or tempfile.mkdtemp(prefix="tickforge-checkpoint-")
    spark.sparkContext.setCheckpointDir(target)
    return target


def settle(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small intermediate result that several branches of a job read.

    Column pruning gives every branch its own copy of the plan, so without it each branch would scan the
    source again.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for a written intermediate table."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
