"""Quality rules by robust multivariate outliers.

Every document gets a vector of transformed text statistics. Per language and source, the minimum covariance
determinant estimate of centre and scatter is found by concentration steps: keep the three quarters of the
group that lie nearest, re-estimate from them, repeat. Documents whose squared Mahalanobis distance exceeds a
chi-square quantile are rejected.

A concentration step is one aggregation over all documents. Squared distances fall into narrow logarithmic
cells; counts, sums and cross products per (group, cell) are combined before the shuffle, so a group of any
size arrives as at most a few thousand rows, and the nearest three quarters are the cells up to the one that
holds that rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.llm.common import fields, staged, text_list
from tickforge.llm.words import WordHashes, windows

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

#: Transformed statistics and the least standard deviation each is given: a spread below it means nothing.
STATISTICS = {"log_words": 0.25, "log_word_length": 0.05, "symbols": 0.04, "upper": 0.04, "marks": 0.04, "repeats": 0.2,
              "dup_lines": 0.2}
KEPT_SHARE = 0.75
STEPS = 6
CELLS_PER_OCTAVE = 16
CONFIDENCE = 0.99999
MIN_GROUP = 200  # smaller groups are judged by the estimate of their language, and those by that of all


def text_statistics(texts: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """The five counts and the transformed statistics of each text."""
    counts, stats = np.zeros((len(texts), len(COUNTS)), "i8"), np.zeros((len(texts), len(STATISTICS)))
    for i, text in enumerate(texts):
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        n = len(words)
        if not n:
            continue
        chars = len(text) - sum(map(text.count, BLANKS))
        symbols = sum(map(text.count, SYMBOLS))
        lines = [x for x in text.split("\n") if x.strip(BLANKS)]
        dup = len(lines) - len(set(lines))
        repeated = 0
        if n > WINDOW:
            _, place, often = np.unique(windows(hashes.of(words), WINDOW), return_inverse=True, return_counts=True)
            starts = np.flatnonzero(often[place] > 1)
            if len(starts):
                edge = np.zeros(n + 1, "i8")
                edge[starts] += 1
                np.subtract.at(edge, starts + WINDOW, 1)
                repeated = int((np.cumsum(edge[:n]) > 0).sum())
        byte = np.bincount(np.frombuffer(raw, "u1"), minlength=128)
        marks = byte[33:48].sum() + byte[58:65].sum() + byte[91:97].sum() + byte[123:127].sum()
        counts[i] = n, chars, symbols, dup, repeated
        stats[i] = (math.log1p(n), math.log(chars / n), math.sqrt(symbols / chars), math.sqrt(byte[65:91].sum() / chars),
                    math.sqrt(marks / chars), math.sqrt(repeated / n), math.sqrt(dup / len(lines)))
    return counts, stats


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """id, the two group columns, the five counts, ``base_failed`` and ``stats`` for every row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            counts, stats = text_statistics(text_list(batch.column(3)), hashes)
            ends = np.arange(0, stats.size + 1, stats.shape[1], dtype="i4")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(c) for c in counts.T),
                 pa.array((counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(stats.ravel()))],
                names=[id_col, "_g0", "_g1", *COUNTS, "base_failed", "stats"])
    schema = T.StructType([*fields(docs, id_col), T.StructField("_g0", T.StringType()), T.StructField("_g1", T.StringType()),
                           *(T.StructField(c, T.LongType()) for c in COUNTS), T.StructField("base_failed", T.BooleanType()),
                           T.StructField("stats", T.ArrayType(T.DoubleType()))])
    return docs.select(id_col, *(F.col(g).cast("string") for g in groups), text_col).mapInArrow(run, schema)


def chi_square(probability: float, p: int) -> float:
    """Quantile by the Wilson-Hilferty approximation."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(probability) * math.sqrt(2 / (9 * p))) ** 3


def _grouped(rows: DataFrame) -> DataFrame:
    """Add ``group``: language and source where that group is large enough, else the language, else all."""
    fit = F.count(F.when(~F.col("base_failed"), 1))
    sizes = rows.groupBy("_g0", "_g1").agg(fit.alias("_n"))
    small = sizes.filter(F.col("_n") < MIN_GROUP).groupBy("_g0").agg(F.sum("_n").alias("_rest"))
    text = F.concat_ws("\x1f", *(F.concat(F.when(F.col(g).isNull(), "n").otherwise("v"), F.coalesce(g, F.lit(""))) for g in ("_g0", "_g1")))
    sizes = sizes.withColumnRenamed("_g0", "_h0").withColumnRenamed("_g1", "_h1")
    small = small.withColumnRenamed("_g0", "_l0")
    chosen = (sizes.join(small, F.col("_h0").eqNullSafe(F.col("_l0")), "left")
              .select("_h0", "_h1", (F.col("_n") >= MIN_GROUP).alias("_own"), (F.col("_rest") >= MIN_GROUP).alias("_pooled")))
    joined = rows.join(chosen, F.col("_g0").eqNullSafe(F.col("_h0")) & F.col("_g1").eqNullSafe(F.col("_h1")), "left")
    lang = F.concat(F.lit("l"), F.coalesce("_g0", F.lit("\x1f")))
    return joined.withColumn("group", F.when(F.col("_own"), text).when(F.col("_pooled"), lang).otherwise("")).drop(
        "_h0", "_h1", "_own", "_pooled")


def _square_distance(p: int) -> Column:
    """Squared Mahalanobis distance of ``stats`` to ``centre`` under ``inverse`` (row by row)."""
    d = [F.col("stats")[i] - F.col("centre")[i] for i in range(p)]
    total = F.lit(0.0)
    for i in range(p):
        row = F.lit(0.0)
        for j in range(p):
            row = row + F.col("inverse")[i * p + j] * d[j]
        total = total + d[i] * row
    return total


ESTIMATE = "group string, n long, centre array<double>, inverse array<double>, middle double, change double"


def _start(rows: DataFrame, p: int) -> DataFrame:
    """Medians and median absolute deviations of each statistic: where the concentration starts."""
    mid = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.array(
        *(F.percentile_approx(F.col("stats")[i], 0.5, 10_000) for i in range(p))).alias("centre"))
    away = rows.join(mid, "group").groupBy("group").agg(F.first("n").alias("n"), F.first("centre").alias("centre"), F.array(
        *(F.percentile_approx(F.abs(F.col("stats")[i] - F.col("centre")[i]), 0.5, 10_000) for i in range(p))).alias("mad"))
    floors = list(STATISTICS.values())
    scales = [F.greatest(F.col("mad")[i] * 1.4826, F.lit(floors[i])) for i in range(p)]
    flat = [1 / (scales[i] * scales[i]) if i == j else F.lit(0.0) for i in range(p) for j in range(p)]
    return away.select("group", "n", "centre", F.array(*flat).alias("inverse"), F.lit(1.0).alias("middle"), F.lit(1.0).alias("change"))


def _cells(rows: DataFrame, estimate: DataFrame, p: int, sums: bool) -> DataFrame:
    """Counts, and with ``sums`` the first and second moments, per group and cell of the squared distance."""
    cell = F.floor(F.log2(F.greatest(_square_distance(p), F.lit(1e-9))) * CELLS_PER_OCTAVE)
    placed = rows.join(estimate, "group").select("group", "stats", "centre", cell.alias("cell"))
    shifted = [F.col("stats")[i] - F.col("centre")[i] for i in range(p)]  # near the centre, so that squares lose nothing
    moments = [F.sum(shifted[i]) for i in range(p)] + [F.sum(shifted[i] * shifted[j]) for i in range(p) for j in range(i, p)]
    return placed.groupBy("group", "cell").agg(
        F.count(F.lit(1)).alias("c"), F.first("centre").alias("centre"), *([F.array(*moments).alias("moments")] if sums else []))


def _concentrate(rows: DataFrame, estimate: DataFrame, p: int) -> DataFrame:
    floors = np.array(list(STATISTICS.values())) ** 2

    def step(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("cell")
        seen = cells["c"].cumsum().to_numpy()
        last = int(np.searchsorted(seen, math.ceil(KEPT_SHARE * seen[-1])))
        near = np.array(cells["moments"].iloc[:last + 1].tolist()).sum(axis=0) / seen[last]
        mean = near[:p]
        scatter = np.zeros((p, p))
        scatter[np.triu_indices(p)] = near[p:]
        scatter = scatter + np.triu(scatter, 1).T - np.outer(mean, mean) + np.diag(floors)
        half = int(np.searchsorted(seen, seen[-1] / 2))
        return pd.DataFrame({"group": [cells["group"].iloc[0]], "n": [int(seen[-1])],
                             "centre": [(np.array(cells["centre"].iloc[0]) + mean).tolist()],
                             "inverse": [np.linalg.inv(scatter).ravel().tolist()],
                             "middle": [2.0 ** ((cells["cell"].iloc[half] + 0.5) / CELLS_PER_OCTAVE)],
                             "change": [float(np.abs(mean).max())]})
    return _cells(rows, estimate, p, True).groupBy("group").applyInPandas(step, ESTIMATE)


def _middles(rows: DataFrame, estimate: DataFrame, p: int) -> DataFrame:
    """The group's median squared distance under the last estimate."""
    def half(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("cell")
        seen = cells["c"].cumsum().to_numpy()
        at = int(np.searchsorted(seen, seen[-1] / 2))
        return pd.DataFrame({"group": [cells["group"].iloc[0]], "median": [2.0 ** ((cells["cell"].iloc[at] + 0.5) / CELLS_PER_OCTAVE)]})
    return _cells(rows, estimate, p, False).select("group", "cell", "c").groupBy("group").applyInPandas(half, "group string, median double")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups: tuple[str, str] = ("lang", "source")) -> DataFrame:
    """id, the five counts, base_failed, kept and distance (squared; scaled down where the nearest part's scatter
    makes its median exceed the chi-square one).

    Documents that fail a base rule are not kept, have no distance and teach nothing. Null groups are groups of
    their own. Groups with under ``MIN_GROUP`` usable documents are pooled by language, and languages still
    smaller together; if all of that is under ``MIN_GROUP``, the pool is judged by itself all the same, with the
    least deviations of ``STATISTICS``. Null and blank texts fail the base rule. Every row gives a row.
    """
    p = len(STATISTICS)
    rows = staged(_grouped(staged(statistics(docs, id_col, text_col, groups), "text-statistics")), "grouped-statistics")
    usable = rows.filter("not base_failed").select("group", "stats")
    estimate = staged(_start(usable, p), "scatter")
    for _ in range(STEPS):
        estimate = staged(_concentrate(usable, estimate, p), "scatter")
    estimate = estimate.join(_middles(usable, estimate, p), "group").select("group", "centre", "inverse", "median")
    scaled = _square_distance(p) * F.least(F.lit(1.0), F.lit(chi_square(0.5, p)) / F.col("median"))
    judged = rows.join(estimate, "group", "left").withColumn("distance", F.when(~F.col("base_failed"), scaled))
    kept = ~F.col("base_failed") & (F.col("distance") <= chi_square(CONFIDENCE, p))
    return judged.select(id_col, *COUNTS, "base_failed", kept.alias("kept"), "distance")
