"""Order-dependent folds written as composable affine maps.

A fold whose step is ``x' = a*x + b`` and ``y' = y + c*x + d`` (with coefficients that do not depend on x
or y) is associative: steps compose into one map. Rows of a key are numbered; runs of ``ROWS`` numbers are composed,
then runs of as many of those, then what is left of the key, so no array holds more than ``ROWS`` maps up to
``ROWS`` cubed rows of one key, however they lie in time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COEFFICIENTS = ("a", "b", "c", "d")
ROWS = 4096


def _compose(order: str) -> Column:
    steps = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), *COEFFICIENTS)))
    one, zero = F.lit(1.0), F.lit(0.0)
    start = F.struct(one.alias("a"), zero.alias("b"), zero.alias("c"), zero.alias("d"))
    return F.aggregate(steps, start, lambda m, s: F.struct(
        (s["a"] * m["a"]).alias("a"), (s["a"] * m["b"] + s["b"]).alias("b"),
        (m["c"] + s["c"] * m["a"]).alias("c"), (m["d"] + s["c"] * m["b"] + s["d"]).alias("d")))


def compose_steps(steps: DataFrame, keys: Sequence[str], number: str, sums: Sequence[str] = (), maxima: Sequence[str] = (),
                  rows: int = ROWS) -> DataFrame:
    """One map (a, b, c, d) per key from one map per row, with plain sums and maxima taken along.

    ``number``: position of the row in its key, from 0.
    """
    keys = list(keys)
    extra = [F.sum(c).alias(c) for c in sums] + [F.max(c).alias(c) for c in maxima]
    out, order = steps, number
    for group in ("_run", "_span", None):
        at = [*keys] if group is None else [*keys, group]
        if group is not None:
            out = out.withColumn(group, F.expr(f"{order} div {rows}"))
        out = out.groupBy(*at).agg(_compose(order).alias("m"), *extra).select(*at, "m.*", *sums, *maxima)
        order = group
    return out
