"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. A document's expected number of copies is its source's target over
its size (times its own weight, if it has one); the whole part of it is taken for certain. The rest of the target
is filled by a fixed-size sample: documents are ranked by random odds divided by inclusion odds and taken in
that order until the words reach it. Random numbers are digests of seed and id, so reruns agree.

No source is sorted as a whole. Ranks fall into fixed cells of (0, 1); words per (source, cell) are summed with
map-side combining, running sums go over one row per cell, and only the cell in which the sample ends is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.llm.common import spare, staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE_PERCENT = 150
MOST_COPIES = 2
CELLS = 4096
WEIGHT_ROUNDS = 6
SEED = "mix"


def word_count(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_percent: int = SHARE_PERCENT) -> DataFrame:
    """(source, source_size) to source, source_size, target.

    Sources in code point order, null last, weigh ``weights`` in turn. No target exceeds ``MOST_COPIES`` times its
    source; what is cut off goes to the others by weight, again until none exceeds. That ends at
    min(most, level x weight) with one level for all, the largest over k of (total - the k smallest caps) /
    (weights of the others), in order of cap per weight. One row per source goes through the two windows.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("long"))
    most = weighed.withColumn("_cap", MOST_COPIES * F.col("source_size"))
    everything = Window.partitionBy()
    earlier = Window.orderBy(F.col("_cap") / F.col("_w"), "_w", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_cap").over(earlier), F.lit(0))
    rest = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(earlier), F.lit(0))
    total = F.sum("source_size").over(everything)
    levels = most.withColumn("_level", (share_percent * total - 100 * before).cast("double") / (100 * rest).cast("double"))
    level = F.max("_level").over(everything)
    return levels.withColumn("target", F.least(F.col("_cap").cast("double"), level * F.col("_w"))).select(
        F.col("source"), "source_size", "target")


def uniform(key: Column, seed: str = SEED) -> Column:
    """A number in (0, 1) from 52 bits of a digest."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("long") + F.lit(0.5)) / F.lit(2.0 ** 52)


def _expected(rows: DataFrame, weight: bool) -> DataFrame:
    """Add ``_e``, the expected copies. With document weights it is min(most, factor x weight), and the factor of a
    source grows in a few rounds until the expected words meet the target as far as the caps allow."""
    ratio = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    if not weight:
        return rows.withColumn("_e", ratio)
    w = F.greatest(F.coalesce(F.col("_weight").cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = rows.withColumn("_weight", F.when(F.isnan(w), 0.0).otherwise(w))
    factor = staged(rows.groupBy("_source", "_target").agg(F.sum(F.col("_weight") * F.col("_size")).alias("_all")).select(
        F.col("_source").alias("_s"), F.when(F.col("_all") > 0, F.col("_target") / F.col("_all")).otherwise(0.0).alias("_factor")), "mix-factors")
    for _ in range(WEIGHT_ROUNDS):
        raw = F.col("_factor") * F.col("_weight")
        capped = F.when(raw >= MOST_COPIES, F.col("_size") * MOST_COPIES).otherwise(0)
        free = F.when(raw < MOST_COPIES, F.col("_size") * raw).otherwise(0.0)
        sums = rows.join(factor, F.col("_source").eqNullSafe(F.col("_s"))).groupBy("_source", "_target", "_factor").agg(
            F.sum(capped).alias("_c"), F.sum(free).alias("_f"))
        grown = F.when(F.col("_f") > 0, F.col("_factor") * F.greatest(F.col("_target") - F.col("_c"), F.lit(0.0)) / F.col("_f"))
        factor = staged(sums.select(F.col("_source").alias("_s"), F.coalesce(grown, F.col("_factor")).alias("_factor")), "mix-factors")
    return rows.join(factor, F.col("_source").eqNullSafe(F.col("_s")), "left").withColumn(
        "_e", F.least(F.lit(float(MOST_COPIES)), F.coalesce(F.col("_factor") * F.col("_weight"), F.lit(0.0)))).drop("_s", "_factor")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
           weight_col: str | None = None, seed: str = SEED, row_key: Column | None = None) -> DataFrame:
    """id, size, source_size, target, copies and taken (copies x size) for every row of ``docs``.

    ``row_key`` comes back as ``_row``. A source's taken words differ from its
    target by at most half of one document. Null texts have size 0; null is a source like any other, ordered last;
    null ids share one random number. Rows with the same random number are ordered by id, size and a digest of the
    text; equal rows are interchangeable. Sources without words have target 0.
    """
    held = [] if row_key is None else [row_key.alias("_row")]
    own = docs.select(
        F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"),
        uniform(F.col(id_col), seed).alias("_u"), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("_text"),
        (F.col(weight_col) if weight_col else F.lit(None).cast("double")).alias("_weight"), *held)
    rows = staged(own, "mix-sizes")
    targets = source_targets(rows.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))).select(
        F.col("source").alias("_t"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    rows = _expected(rows.join(targets, F.col("_source").eqNullSafe(F.col("_t"))).drop("_t"), weight_col is not None)
    chance = F.col("_e") - F.floor("_e")
    odds = (F.col("_u") / (1 - F.col("_u"))) / (chance / (1 - chance))
    ranked = rows.withColumn("_whole", F.floor("_e")).withColumn("_q", F.when(chance > 0, odds)).withColumn(
        "_cell", F.least(F.floor(F.col("_q") / (1 + F.col("_q")) * CELLS), F.lit(CELLS - 1)))

    per_cell = ranked.groupBy("_source", "_target", "_cell").agg(
        F.sum(F.col("_whole") * F.col("_size")).alias("_sure"), F.sum(F.when(F.col("_q").isNotNull(), F.col("_size")).otherwise(0)).alias("_words"))
    whole = Window.partitionBy("_source")
    along = whole.orderBy(F.col("_cell").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    cells = per_cell.withColumn("_left", F.col("_target") - F.sum("_sure").over(whole)).withColumn(
        "_before", F.coalesce(F.sum("_words").over(along), F.lit(0)))
    # the sample ends in the last cell that starts within the words left
    ends = cells.filter(F.col("_cell").isNotNull() & (F.col("_before") <= F.col("_left"))).groupBy(F.col("_source").alias("_s")).agg(
        F.max_by(F.struct("_cell", "_before", "_left"), "_cell").alias("_end"))
    placed = ranked.join(ends, F.col("_source").eqNullSafe(F.col("_s")), "left")
    columns = [*(["_row"] if held else []), "_id", "_size", "_source_size", "_target"]
    at = F.col("_cell") == F.col("_end._cell")
    clear = placed.filter(~F.coalesce(at, F.lit(False))).select(
        *columns, (F.col("_whole") + F.coalesce((F.col("_cell") < F.col("_end._cell")).cast("int"), F.lit(0))).alias("_copies"))
    order = Window.partitionBy("_source").orderBy("_q", "_id", "_size", "_text").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.col("_end._before") + F.coalesce(F.sum("_size").over(order), F.lit(0))
    fits = (2 * earlier + F.col("_size")).cast("double") <= 2 * F.col("_end._left")
    last = placed.filter(at).select(*columns, (F.col("_whole") + fits.cast("int")).alias("_copies"))
    out = clear.unionByName(last)
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                      F.col("_target").alias("target"), F.col("_copies").cast("long").alias("copies"),
                      (F.col("_copies") * F.col("_size")).cast("long").alias("taken"), *(["_row"] if held else []))


def mixed(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """The mix itself: each row of ``docs``, with all its columns, as often as it is taken.

    Copies are found from narrow rows and come back by a 64-bit hash of the row, so texts are shuffled once. Equal rows
    are interchangeable: one of them stands for the copies of all.
    """
    key = F.xxhash64(*(f.name for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)))
    taken = copies(docs, id_col, text_col, source_col, row_key=key).groupBy(F.col("_row").alias("_k")).agg(
        F.sum("copies").cast("int").alias("_times")).filter("_times > 0")
    name = spare(docs, "_row_key")
    keyed = docs.withColumn(name, key).dropDuplicates([name])
    found = keyed.join(staged(taken, "mix-copies"), F.col(name) == F.col("_k"))
    return found.select(*docs.columns, F.explode(F.array_repeat(F.lit(0), F.col("_times"))).alias(name)).drop(name)


SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
             (('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
             md5(coalesce(text, '')) AS h FROM documents),
  s AS (SELECT source, sum(size)::BIGINT AS source_size,
          CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM d GROUP BY source),
  l AS (SELECT source, source_size, w, 2 * source_size AS cap,
          (150 * sum(source_size) OVER () - 100 * coalesce(sum(2 * source_size) OVER e, 0))::DOUBLE
            / (100 * (sum(w) OVER () - coalesce(sum(w) OVER e, 0)))::DOUBLE AS level
        FROM s WINDOW e AS (ORDER BY 2 * source_size::DOUBLE / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  t AS (SELECT source, source_size, least(cap::DOUBLE, max(level) OVER () * w) AS target FROM l),
  r AS (SELECT d.doc_id, d.size, d.h, d.u, t.source, t.source_size, t.target,
          CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e
        FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
  q AS (SELECT *, floor(e)::BIGINT AS n, e - floor(e) AS f FROM r),
  c AS (SELECT *, CASE WHEN f > 0 THEN (u / (1 - u)) / (f / (1 - f)) END AS odds FROM q),
  o AS (SELECT *, target - sum(n * size) OVER (PARTITION BY source) AS rest,
          coalesce(sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id, size, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM c)
SELECT doc_id, size, source_size, target, (n + CASE WHEN odds IS NOT NULL AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END)::BIGINT AS copies,
  ((n + CASE WHEN odds IS NOT NULL AND 2 * before + size <= 2 * rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM o
"""
