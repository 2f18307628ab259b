"""Exact global ranks and exact medians without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.session import checkpoint_dir


def global_rank(df: DataFrame, order: Sequence[Column], rank: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """row_number over the whole frame along a unique ``order``, spread over range partitions.

    Rows are range-partitioned by the full order key, checkpointed so that the partition bounds cannot
    change between the two passes, numbered inside each partition and shifted by the number of rows in
    the partitions before it.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = (
        df.repartitionByRange(n, *order).withColumn("_pid", F.spark_partition_id()).checkpoint(eager=True)
    )
    sizes = placed.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_pid").orderBy(*order)
    return (
        placed.withColumn("_rn", F.row_number().over(inside))
        .join(offsets, "_pid")
        .withColumn(rank, (F.col("_rn") + F.col("_off")).cast("long"))
        .drop("_pid", "_rn", "_off")
    )


def top_ranked(df: DataFrame, order: Sequence[Column], n: int, rank: str = "rank",
               offset: int = 0) -> DataFrame:
    """The best ``n`` rows with their rank; only ``n + offset`` rows reach the numbering step."""
    best = df.orderBy(*order).limit(n + offset)
    ranked = best.withColumn(rank, F.row_number().over(Window.orderBy(*order)).cast("long"))
    return ranked.filter(F.col(rank) > offset) if offset else ranked


def group_median(df: DataFrame, keys: Sequence[str], value: str, out: str = "median", weight: str | None = None) -> DataFrame:
    """Exact median (mean of the two middle values) of a non-negative column per group.

    Equal values are counted first. A coarse, order-preserving cell of the value (64 per octave) gives
    per-group prefix counts; only the one or two cells that hold the middle ranks are then sorted.
    ``weight`` names a multiplicity column when equal values are already counted.
    """
    keys = list(keys)
    times = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = df.groupBy(*keys, value).agg(times.alias("c")).withColumn(
        "cell", F.floor(F.log2(F.lit(1.0) + F.col(value)) * 64))
    cells = counted.groupBy(*keys, "cell").agg(F.sum("c").alias("cc"))
    along = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    middle = (
        cells.withColumn("cum", F.sum("cc").over(along)).withColumn("total", F.sum("cc").over(whole))
        .withColumn("lo", F.floor((F.col("total") + 1) / 2)).withColumn("hi", F.floor(F.col("total") / 2) + 1)
        .filter((F.col("cum") >= F.col("lo")) & (F.col("cum") - F.col("cc") < F.col("hi")))
        .select(*keys, "cell", (F.col("cum") - F.col("cc")).alias("base"), "lo", "hi")
    )
    in_cell = Window.partitionBy(*keys, "cell").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.join(middle, [*keys, "cell"]).withColumn("to", F.col("base") + F.sum("c").over(in_cell))
    frm = F.col("to") - F.col("c")
    return ranked.groupBy(*keys).agg(
        ((F.max(F.when((frm < F.col("lo")) & (F.col("to") >= F.col("lo")), F.col(value)))
          + F.max(F.when((frm < F.col("hi")) & (F.col("to") >= F.col("hi")), F.col(value)))) / 2).alias(out)
    )
