"""Small helpers that several text operators share."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.session import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_held_out(id_col: str | Column = "doc_id") -> Column:
    """The fold that no model may learn from: crc32 of the id as text leaves remainder 1."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it back: the lineage ends there, and a
    lost executor costs a re-read instead of a recomputation."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to a fresh table bucketed by ``key`` without shuffling it, and read that: joins and groups on
    the key need no exchange of this side."""
    spark = df.sparkSession
    made = f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, key).option("path", scratch_path(spark, name)).option("compression", compression).saveAsTable(made)
    return spark.table(made)


def spare(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fields(df: DataFrame, *names: str) -> list[T.StructField]:
    return [T.StructField(n, df.schema[n].dataType, True) for n in names]


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows, which bounds what a piece is unpacked to."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_list(column: pa.Array) -> list[str]:
    """The column's texts, empty for null."""
    return [x or "" for x in column.to_pylist()]


def bytes_list(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8, empty for null."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def give_back() -> None:
    """Return freed memory of this worker process to the system, so that the next task's is not added to it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function over batches that gives its memory back when it is through."""
    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        give_back()
    return wrapped


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict], schema: T.StructType) -> DataFrame:
    """Apply a function from an Arrow batch to columns (in schema order) to every non-empty batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(fn(batch))
    return df.mapInArrow(run, schema)
