"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is the sign bits of a vector, cut into segments of ``SEGMENT_BITS`` bits; every distinct code is indexed under
the value of each of its segments. Codes at distance m * a + m - 1 or less from a query, with m segments, differ
by at most a bits from it in some segment. So a round probes every segment value within radius a, verifies
the whole distance of what it finds, and a query is finished when its k-th verified distance is covered by that
bound. The rest go on with a larger radius.

Equal codes are searched and found once, whatever their number; of their rows the k smallest ids are kept.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.llm.common import fields, staged

K = 10
SEGMENT_BITS = 16


def codes(vectors: DataFrame, segments: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, code): the segments of the sign bits; missing and null elements count as zero bits."""
    bits = segments * SEGMENT_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = 1 << np.arange(SEGMENT_BITS)
        for batch in batches:
            column = batch.column(1)
            sizes = np.asarray(column.value_lengths(), "i8")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
            signs = np.zeros((len(sizes), bits), bool)
            row = np.repeat(np.arange(len(sizes)), sizes)
            signs[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat > 0
            values = (signs.reshape(-1, SEGMENT_BITS) * weights).sum(axis=1).astype("i4")
            ends = np.arange(0, len(values) + 1, segments, dtype="i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=[id_col, "code"])
    known = vectors.select(id_col, vector_col).dropna()
    return known.mapInArrow(run, T.StructType([*fields(vectors, id_col), T.StructField("code", T.ArrayType(T.IntegerType()))]))


@functools.lru_cache(maxsize=SEGMENT_BITS + 1)
def masks(radius: int) -> np.ndarray:
    """All segment values with at most ``radius`` bits set."""
    values = np.arange(1 << SEGMENT_BITS, dtype="u4")
    return values[np.unpackbits(values.view("u1").reshape(-1, 4), axis=1).sum(axis=1) <= radius].astype("i4")


def _probes(queries: DataFrame, segments: int, radius: int) -> DataFrame:
    """(query, segment, value) for every segment value within the radius of the query's."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = masks(radius)
        for batch in batches:
            for i, code in enumerate(batch.column(0).to_pylist()):
                values = np.concatenate([near ^ np.int32(v) for v in code])
                yield pa.RecordBatch.from_arrays(
                    [pa.concat_arrays([batch.column(0).slice(i, 1)]).take(pa.array(np.zeros(len(values), "i4"))),
                     pa.array(np.repeat(np.arange(segments, dtype="i4"), len(near))), pa.array(values)],
                    names=["query", "segment", "value"])
    spread = queries.select("query").repartition(int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions")), "query")
    return spread.mapInArrow(run, "query array<int>, segment int, value int")


def _apart(segments: int, upto: int | None = None) -> list[Column]:
    return [F.bit_count(F.col("code")[j].bitwiseXOR(F.col("query")[j])) for j in range(segments if upto is None else upto)]


def _round(queries: DataFrame, index: DataFrame, segments: int, radius: int) -> DataFrame:
    """(query, code, rows, distance) for every code within the distance that the radius covers, each pair once."""
    distance = functools.reduce(Column.__add__, _apart(segments))
    covered = segments * radius + segments - 1
    first = F.lit(True)  # found by an earlier segment already
    for j in range(segments):
        earlier = functools.reduce(Column.__and__, [d > radius for d in _apart(segments, j)], F.lit(True))
        first = first & ((F.col("segment") != j) | earlier)
    # probes are many times the queries they come from, which is all that size estimates see: never broadcast them
    found = _probes(queries, segments, radius).hint("merge").join(index, (F.col("segment") == F.col("at")) & (F.col("value") == F.col("held")) &
                                                    (distance <= covered) & first)
    return found.select("query", "code", "rows", distance.cast("int").alias("distance"))


def search(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding",
           bits: int | None = None) -> DataFrame:
    """query_id, rank, neighbor_id, distance: the k rows of ``vectors`` nearest to each row of ``queries``.

    The order is by distance, then id; a query that is itself a row finds itself. Rows with a null id or vector are
    neither found nor queries. Rows with equal ids are found as often as they stand there, but a repeated query row
    is answered once. With fewer than k rows all are returned; an empty table gives an empty result. ``bits``
    defaults to the longest vector.
    """
    longest = bits or vectors.agg(F.max(F.size(vector_col))).first()[0] or 1
    segments = max(1, -(-int(longest) // SEGMENT_BITS))
    rows = staged(codes(vectors, segments, id_col, vector_col), "codes")
    asked = staged(codes(queries, segments, id_col, vector_col).distinct(), "query-codes")
    index = staged(rows.groupBy("code").agg(F.count(F.lit(1)).alias("rows")).select("code", "rows", F.posexplode("code").alias("at", "held")), "code-index")
    needed = min(k, rows.limit(k).count())
    left = staged(asked.select(F.col("code").alias("query")).distinct(), "open-queries")
    found = None
    for radius in range(SEGMENT_BITS + 1 if needed else 0):
        near = staged(_round(left, index, segments, radius), "near-codes")
        enough = near.groupBy(F.col("query").alias("done")).agg(F.sum("rows").alias("n")).filter(F.col("n") >= needed).select("done")
        part = near.join(enough, F.col("query") == F.col("done"), "left_semi")
        found = part if found is None else found.unionByName(part)
        left = staged(left.join(enough, F.col("query") == F.col("done"), "left_anti"), "open-queries")
        if left.isEmpty():
            break
    out = [F.col("asked").alias("query_id"), "rank", F.col("neighbor").alias("neighbor_id"), "distance"]
    if found is None:
        return rows.select(F.col(id_col).alias("query_id"), F.lit(0).alias("rank"), F.col(id_col).alias("neighbor_id"),
                           F.lit(0).alias("distance")).filter("false")
    few = rows.withColumn("_n", F.row_number().over(Window.partitionBy("code").orderBy(id_col))).filter(F.col("_n") <= k)
    nearest = Window.partitionBy("query").orderBy("distance", "neighbor")
    hits = found.select("query", "code", "distance").join(few.select("code", F.col(id_col).alias("neighbor")), "code")
    top = hits.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
    return asked.select(F.col(id_col).alias("asked"), F.col("code").alias("query")).join(top.drop("code"), "query").select(*out)


SQL = f"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x > 0) AS b FROM embeddings),
  q AS (SELECT vec_id AS query_id, b FROM e WHERE vec_id % 100 = 0),
  p AS (SELECT q.query_id, e.vec_id AS neighbor_id,
          len(list_filter(list_zip(q.b, e.b), lambda z: z[1] <> z[2]))::INT AS distance FROM q CROSS JOIN e),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INT AS rank FROM p)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= {K}
"""
