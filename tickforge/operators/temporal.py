"""As-of joins, range windows, running sums and islands that split long keys into time chunks.

A key that holds a third of all rows would otherwise be one window partition. Each operator first
reduces its input to one row per (key, instant), works inside fixed time chunks of a key, and carries
one summary row per chunk across chunk borders, so the largest group is bounded by the chunk width.
Running sums, which cannot merge instants, cut keys by rows instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.session import checkpoint_dir


def asof_lookup(points: DataFrame, events: DataFrame, by: Sequence[str], ts: str, values: Sequence[str],
                tie: str, tolerance: int | None = None, chunk: int = 3600) -> DataFrame:
    """For every distinct (by, ts) in ``points`` the values of the newest event at or before ts.

    Events at the same instant are visible to points of that instant; among equal instants the
    greatest ``tie`` wins. Output: by, ts, values and ``matched_ts`` (null when unmatched).
    """
    by = list(by)
    last_per_instant = events.groupBy(*by, ts).agg(F.max_by(F.struct(*values), F.col(tie)).alias("v"))
    marks = points.select(*by, ts).distinct().withColumn("v", F.lit(None).cast(last_per_instant.schema["v"].dataType))
    timeline = (
        last_per_instant.withColumn("q", F.lit(0)).unionByName(marks.withColumn("q", F.lit(1)))
        .groupBy(*by, ts).agg(F.first("v", ignorenulls=True).alias("v"), F.max("q").alias("q"))
        .withColumn("m", F.when(F.col("v").isNotNull(), F.struct(F.col(ts).alias("mts"), F.col("v"))))
        .withColumn("chunk", F.floor(F.col(ts) / chunk))
    )
    inside = Window.partitionBy(*by, "chunk").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    # Both branches read the same columns of the timeline, so its shuffle is built once and reused.
    carry = (
        timeline.groupBy(*by, "chunk").agg(F.max_by("m", F.col("m.mts")).alias("m"), F.max("q").alias("asked"))
        .withColumn("carry", F.last("m", ignorenulls=True).over(across))
        .select(*by, "chunk", "carry", "asked")
    )
    found = (
        timeline.withColumn("here", F.last("m", ignorenulls=True).over(inside))
        .filter(F.col("q") == 1)
        .join(carry.filter("asked = 1"), [*by, "chunk"], "left")
        .withColumn("hit", F.coalesce("here", "carry"))
    )
    ok = F.col("hit").isNotNull()
    if tolerance is not None:
        ok = ok & (F.col(ts) - F.col("hit.mts") <= tolerance)
    return found.select(
        *by, ts, F.when(ok, F.col("hit.mts")).alias("matched_ts"),
        *[F.when(ok, F.col(f"hit.v.{c}")).alias(c) for c in values],
    )


def asof_join(left: DataFrame, events: DataFrame, by: Sequence[str], ts: str, values: Sequence[str],
              tie: str, tolerance: int | None = None, chunk: int = 3600) -> DataFrame:
    """``left`` with the newest event values at or before its ``ts`` (null when none)."""
    hits = asof_lookup(left, events, by, ts, values, tie, tolerance, chunk)
    return left.join(hits, [*by, ts], "left")


def range_mean(df: DataFrame, by: Sequence[str], ts: str, value: str, radius: int, out: str,
               chunk: int = 3600) -> DataFrame:
    """Mean of ``value`` over rows of the same key within ``radius`` seconds on either side.

    Rows are first summed per (key, second) and cut into blocks of ``radius`` seconds (``chunk`` without a radius). The range
    around a second is its own block, an end of the block before and a start of the block after. Each block also gets those
    two, moved onto its own seconds, so both parts are running sums and no range is summed row by row.
    """
    by = list(by)
    width = radius or chunk
    per_second = df.groupBy(*by, ts).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    block = F.floor(F.col(ts) / width)
    place = lambda role, blocks: F.struct(F.lit(role).alias("role"), (block + blocks).alias("block"), (F.col(ts) + blocks * radius).alias("at"))
    placed = per_second.withColumn("x", F.explode(F.array(place(0, 0), *([place(-1, 1), place(1, -1)] if radius else []))))
    in_block = Window.partitionBy(*by, "x.block")
    upto, since = in_block.orderBy("x.at"), in_block.orderBy(F.desc("x.at"))
    # Growing ranges with all rows of their last second: rows of the block after up to here, of the block before from here on.
    grow = lambda w: w.rangeBetween(Window.unboundedPreceding, 0)
    role = F.col("x.role")
    def total(c: str) -> Column:
        part = lambda r, w: F.coalesce(F.sum(F.when(role == r, F.col(c))).over(w), F.lit(0))
        own = part(0, in_block) if radius else F.coalesce(c, F.lit(0))
        return part(-1, grow(since)) + own + part(1, grow(upto)) if radius else own
    means = (
        placed.withColumn("rs", total("s")).withColumn("rn", total("n")).filter(role == 0)
        .select(*by, ts, F.try_divide("rs", "rn").alias(out))
    )
    return df.join(means, [*by, ts], "left")


def running_sums(df: DataFrame, by: Sequence[str], order: str, cols: Sequence[str], suffix: str = "_after",
                 before: bool = False, partitions: int | None = None) -> DataFrame:
    """Running totals of ``cols`` per key along a ``order`` that is unique per key.

    Rows are range-partitioned by (key, order) and checkpointed, so that the partition bounds stay; a key's rows are summed
    inside each partition and shifted by its totals in the partitions before. No window holds more rows than a partition,
    whatever a key or an instant of it has; ``partitions`` defaults to the shuffle partitions.
    """
    by = list(by)
    spark = df.sparkSession
    checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *by, order).withColumn("_part", F.spark_partition_id()).checkpoint(eager=True)
    totals = placed.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    prefix = totals.select(
        *by, "_part", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_p_{c}") for c in cols]
    )
    inside = Window.partitionBy("_part", *by).orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1 if before else 0)
    out = placed
    for c in cols:
        out = out.withColumn(f"_r_{c}", F.coalesce(F.sum(c).over(inside), F.lit(0)))
    out = out.join(prefix, [*by, "_part"], "left")
    for c in cols:
        out = out.withColumn(f"{c}{suffix}", F.col(f"_r_{c}") + F.col(f"_p_{c}"))
    return out.drop("_part", *[f"_r_{c}" for c in cols], *[f"_p_{c}" for c in cols])


def over_spans(spans: DataFrame, by: Sequence[str], first: str, last: str, out: str, aggs: Sequence[Column], merges: Sequence[Column],
               step: int = 3600) -> DataFrame:
    """``aggs`` per (by, instant ``out``) over the spans that hold the instant; no span is expanded into its instants.

    ``first`` and ``last`` are multiples of ``step``. A span is cut into blocks of 1, 2, 4, ... steps that start at multiples of
    their length, at most two of a length; spans are aggregated per block, and only the block rows meet their instants, where
    ``merges`` joins them.
    """
    by = list(by)
    low, high = F.floor(F.col(first) / step), F.floor(F.col(last) / step) + 1
    odd = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 1
    blocks = (
        spans.withColumn("_a", low).withColumn("_b", high).filter("_a < _b")
        .withColumn("_k", F.explode(F.expr("sequence(0, length(bin(_b - _a)) - 1)")))
        .withColumn("_l", F.expr("shiftright(_a + shiftleft(1L, _k) - 1, _k)")).withColumn("_r", F.expr("shiftright(_b, _k)"))
        .filter((F.col("_l") < F.col("_r")) & (odd("_l") | odd("_r")))
        .withColumn("_n", F.explode(F.array(F.when(odd("_l"), F.col("_l")), F.when(odd("_r"), F.col("_r") - 1))))
        .filter("_n IS NOT NULL")
    )
    per_block = blocks.groupBy(*by, "_k", "_n").agg(*aggs)
    instants = per_block.withColumn("_i", F.explode(F.expr("sequence(shiftleft(_n, _k), shiftleft(_n + 1, _k) - 1)")))
    return instants.withColumn(out, F.col("_i") * step).groupBy(*by, out).agg(*merges)


def islands(points: DataFrame, ts: str, flag: str, weight: str, chunk: int = 86400) -> DataFrame:
    """Runs of equal ``flag`` along ``ts``: start, end, flag, points and weight per run.

    ``points`` has one row per instant. Runs are found per time chunk; only the first and last run of
    a chunk can continue elsewhere, so the cross-chunk pass sees at most two rows per chunk.
    """
    w = Window.partitionBy("chunk").orderBy(ts)
    wf = Window.partitionBy("chunk", flag).orderBy(ts)
    runs = (
        points.select(ts, flag, weight).withColumn("chunk", F.floor(F.col(ts) / chunk))
        .withColumn("g", F.row_number().over(w) - F.row_number().over(wf))
        .groupBy("chunk", flag, "g")
        .agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("points"),
             F.sum(weight).alias("weight"))
    )
    edge = Window.partitionBy("chunk")
    runs = runs.withColumn("is_edge", (F.col("start") == F.min("start").over(edge))
                           | (F.col("end") == F.max("end").over(edge)))
    g = Window.orderBy("start")
    border = (
        runs.filter("is_edge")
        .withColumn("prev", F.lag(flag).over(g)).withColumn("prev_chunk", F.lag("chunk").over(g))
        .withColumn("new", F.when((F.col("prev") == F.col(flag)) & (F.col("prev_chunk") != F.col("chunk")), 0)
                    .otherwise(1))
        .withColumn("run", F.sum("new").over(g.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("run", flag)
        .agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("points").alias("points"),
             F.sum("weight").alias("weight"))
    )
    cols = [flag, "start", "end", "points", "weight"]
    return border.select(*cols).unionByName(runs.filter(~F.col("is_edge")).select(*cols))
