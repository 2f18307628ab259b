"""Per-key selection and upserts expressed as aggregations, so hot keys combine before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickforge.session import settle


def _order(order: Sequence[str] | str) -> Column:
    names = [order] if isinstance(order, str) else list(order)
    return F.col(names[0]) if len(names) == 1 else F.struct(*names)


def _pick(df: DataFrame, keys: Sequence[str], order, agg) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(agg(F.struct(*rest), _order(order)).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] | str) -> DataFrame:
    """The row with the greatest ``order`` per key (map-side combine, no window)."""
    return _pick(df, keys, order, F.max_by)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] | str) -> DataFrame:
    return _pick(df, keys, order, F.min_by)


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  rank: str = "rn") -> DataFrame:
    """First ``n`` rows per group; Spark prunes each partition to ``n`` rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
    return kept.withColumn(rank, F.col(rank).cast("long"))


def insert_ignore(target: DataFrame, batch: DataFrame, keys: Sequence[str],
                  order: Sequence[str] | str) -> DataFrame:
    """Append rows whose key is absent; within the batch the first write wins."""
    fresh = first_per_key(batch, keys, order).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def upsert_replace(target: DataFrame, batch: DataFrame, keys: Sequence[str],
                   order: Sequence[str] | str) -> DataFrame:
    """Last write per key wins; batch rows beat target rows."""
    cols = target.columns
    names = [order] if isinstance(order, str) else list(order)
    both = target.withColumn("_gen", F.lit(0)).unionByName(batch.select(*cols).withColumn("_gen", F.lit(1)))
    return latest_per_key(both, keys, ["_gen", *names]).select(*cols)


def upsert_merge_add(state: DataFrame, deltas: DataFrame, keys: Sequence[str], add: Sequence[str] = (),
                     keep_min: Sequence[str] = (), keep_max: Sequence[str] = ()) -> DataFrame:
    """Additive upsert: counters are summed, minima and maxima kept."""
    cols = [*keys, *add, *keep_min, *keep_max]
    both = state.select(*cols).unionByName(deltas.select(*cols))
    aggs = [F.sum(c).alias(c) for c in add] + [F.min(c).alias(c) for c in keep_min]
    aggs += [F.max(c).alias(c) for c in keep_max]
    return both.groupBy(*keys).agg(*aggs)


def upsert_coalesce(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Two event kinds each fill their half of a row; shared columns take the first non-null."""
    shared = [c for c in left.columns if c in right.columns and c not in keys]
    l = left.select(*keys, *[F.col(c).alias(f"_l_{c}") if c in shared else F.col(c)
                             for c in left.columns if c not in keys])
    rr = right.select(*keys, *[F.col(c).alias(f"_r_{c}") if c in shared else F.col(c)
                               for c in right.columns if c not in keys])
    out = l.join(rr, list(keys), "full_outer")
    for c in shared:
        out = out.withColumn(c, F.coalesce(f"_l_{c}", f"_r_{c}")).drop(f"_l_{c}", f"_r_{c}")
    return out


def last_non_null_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str] | str,
                          cols: Sequence[str]) -> DataFrame:
    """Slowly changing state: per column the last non-null value by ``order``."""
    by = _order(order)
    return df.groupBy(*keys).agg(
        *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), by)).alias(c) for c in cols]
    )


def components(edges: DataFrame) -> DataFrame:
    """Connected components of (u, v) edges: one row per node with the least node of its component.

    Large and small stars in turn: every node's neighbours are linked to the least of them, once upwards and once downwards,
    until each node has one link, to a node without any. The rounds grow with the logarithm of the nodes, not with the
    length of a chain, and no neighbourhood is collected.
    """
    e = settle(edges.filter("u IS NOT NULL AND v IS NOT NULL").select("u", "v").distinct())
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    while True:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        up = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = settle(down.union(low.select("u", F.col("m").alias("v"))).distinct())
        chained = e.join(e.select(F.col("u").alias("v")), "v", "left_semi").select("u")
        if e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("u").union(chained).isEmpty():
            break
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component"))
