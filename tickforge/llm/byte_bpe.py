"""Byte-level BPE by a global shuffle of distinct words.

Documents are packed into blocks. A block keeps its distinct pre-tokens once and, for every position, the
number of the pre-token there, so a word is shuffled once per block and not per occurrence. The words of a
block are dealt to buckets by a hash; the exploded packs of all blocks meet by bucket, every distinct word is
encoded once, the ids go back to the blocks, and each document is put together by position. The block table
is bucketed by block, so that only the words are shuffled, never the texts.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.llm.common import bucketed, fields, give_back, lean, text_list

BLOCK_CHARS = 6_000_000  # texts of a block, and so the memory of one cogroup; one longer text is a block of its own
DECODED_ROWS = 500  # rows decoded at once
END = b"\xff"  # a byte that UTF-8 never contains, between the words of a pack
PLANES = 4  # bytes of a pre-token's number, stored byte by byte because the upper ones are nearly constant


@functools.lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=2)
def _word_encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={}).encode_ordinary


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token-byte table by id: all bytes, and where each token begins and how long it is (0: no such id)."""
    by_id = {i: b for b, i in ranks(path).items()}
    tokens = [by_id.get(i, b"") for i in range(max(by_id, default=-1) + 1)]
    widths = np.array([len(t) for t in tokens], "i8")
    return np.frombuffer(b"".join(tokens), "u1"), np.cumsum(widths) - widths, widths


def _packed(numbers: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(numbers, "<u4").view("u1").reshape(-1, PLANES).T.tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), "u1").reshape(PLANES, -1).T).view("<u4").ravel()


class _Numbering(dict):
    """Words of one block as numbers in order of appearance."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def blocks(docs: DataFrame, pattern: str, buckets: int, id_col: str = "doc_id", text_col: str = "text",
           block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per block: block, ids, sizes (pre-tokens of each document), numbers (the pre-token at each
    position), and by bucket its distinct words and their numbers."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, part, count = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0
        held = _Numbering()
        ids, numbers, chars = [], [], 0

        def close() -> pa.RecordBatch:
            flat = np.concatenate(numbers)
            often = np.argsort(-np.bincount(flat, minlength=len(held)), kind="stable")
            place = np.empty(len(held), "u4")  # frequent words get small numbers, which pack well
            place[often] = np.arange(len(held), dtype="u4")
            dealt: dict[int, list[tuple[bytes, int]]] = {}
            for w, n in held.items():
                raw = w.encode()
                dealt.setdefault(xxhash.xxh3_64_intdigest(raw) % buckets, []).append((raw, place[n]))
            dealt = {b: sorted(x) for b, x in sorted(dealt.items())}
            return pa.RecordBatch.from_pydict({
                "block": pa.array([part << 32 | count]), "ids": pa.array([ids], pa.list_(kind)),
                "sizes": pa.array([[len(x) for x in numbers]], pa.list_(pa.int32())), "numbers": pa.array([_packed(place[flat])]),
                "buckets": pa.array([list(dealt)], pa.list_(pa.int32())),
                "words": pa.array([[zstandard.compress(END.join(w for w, _ in x)) for x in dealt.values()]], pa.list_(pa.binary())),
                "places": pa.array([[_packed(np.array([n for _, n in x], "u4")) for x in dealt.values()]], pa.list_(pa.binary()))})

        for batch in batches:
            kind = batch.column(0).type
            for i, text in zip(batch.column(0).to_pylist(), text_list(batch.column(1)), strict=True):
                ids.append(i)
                found = find(text)
                numbers.append(np.fromiter(map(held.__getitem__, found), "u4", len(found)))
                chars += len(text) + 1
                if chars >= block_chars:
                    yield close()
                    held, ids, numbers, chars, count = _Numbering(), [], [], 0, count + 1
        if ids:
            yield close()

    schema = T.StructType([
        T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
        T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("numbers", T.BinaryType()),
        T.StructField("buckets", T.ArrayType(T.IntegerType())), T.StructField("words", T.ArrayType(T.BinaryType())),
        T.StructField("places", T.ArrayType(T.BinaryType()))])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def word_ids(packs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(block, pack, bucket, words) to (block, pack, widths, token_ids).

    Equal words meet in one bucket, whose packs follow each other in one partition, so each distinct word is
    encoded once. Memory is one bucket's distinct words; a word stands at most once in a pack, so frequent
    words weigh little more than others.
    """
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, bucket, known = _word_encoder(path, pattern), None, {}
        for batch in batches:
            out = []
            for b, words in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b != bucket:
                    bucket, known = b, {}
                split = zstandard.decompress(words).split(END)
                for w in split:
                    if w not in known:
                        known[w] = encode(w.decode())
                ids = [known[w] for w in split]
                out.append((_packed(np.array([len(x) for x in ids], "u4")), _packed(np.fromiter(chain.from_iterable(ids), "u4"))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.binary())],
                names=["block", "pack", "widths", "token_ids"])
    met = packs.select("block", "pack", "bucket", "words").repartition("bucket").sortWithinPartitions("bucket")
    return met.mapInArrow(run, "block long, pack int, widths binary, token_ids binary")


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text",
           block_chars: int = BLOCK_CHARS, buckets: int | None = None) -> DataFrame:
    """id and ids (array of int) of every whole text, in the ids of the rank file ``path``.

    ``buckets`` (default: eight per shuffle partition) divides the vocabulary for encoding. Null and empty texts
    give an empty array. Every input row gives one row: repeated rows and null or equal ids are kept as they
    are. An empty table gives an empty table; other columns of ``docs`` are not read.
    """
    n = buckets or 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = bucketed(blocks(docs, pattern, n, id_col, text_col, block_chars), "block", "bpe_blocks", "uncompressed")
    packs = held.select("block", "buckets", F.posexplode("words").alias("pack", "words")).select(
        "block", "pack", F.col("buckets")[F.col("pack")].alias("bucket"), "words")
    found = word_ids(packs, path, pattern)
    schema = T.StructType([*fields(docs, id_col), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    kind = T.StructType(fields(docs, id_col))

    def reassemble(block: pa.Table, known: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        by_pack = {p: (w, t) for p, w, t in zip(known["pack"].to_pylist(), known["widths"].to_pylist(), known["token_ids"].to_pylist(), strict=True)}
        places = [_unpacked(x) for x in block["places"][0].as_py()]
        packs = [by_pack[p] for p in range(len(places))]
        none = np.empty(0, "u4")
        place = np.concatenate([none, *places])
        width = np.concatenate([none, *(_unpacked(w) for w, _ in packs)]).astype("i8")
        tokens = np.concatenate([none, *(_unpacked(t) for _, t in packs)])
        begins, widths = np.zeros(len(place), "i8"), np.zeros(len(place), "i8")
        begins[place], widths[place] = np.cumsum(width) - width, width
        flat = _unpacked(block["numbers"][0].as_py())
        ends = np.concatenate([[0], np.cumsum(widths[flat])])
        at = np.repeat((begins[flat] - ends[:-1]).astype("i4"), widths[flat]) + np.arange(ends[-1], dtype="i4")
        ends = ends[np.concatenate([[0], np.cumsum(np.array(block["sizes"][0].as_py(), "i8"))])]
        ids = pa.array(block["ids"][0].as_py(), to_arrow_schema(kind).field(0).type)
        give_back()
        return pa.table({id_col: ids, "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(tokens[at].astype("i4")))})

    return held.select("block", "ids", "sizes", "numbers", "places").groupBy("block").cogroup(found.groupBy("block")).applyInArrow(
        reassemble, schema)


def decode(rows: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, ids and the bytes they stand for, by a map-side join with the token-byte table (one row per entry of
    the vocabulary file, which bounds it). Null ids give no bytes; an id outside the vocabulary is an error."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, begins, widths = token_bytes(path)
        for whole in batches:
            for first in range(0, whole.num_rows, DECODED_ROWS):
                batch = whole.slice(first, DECODED_ROWS)
                ids = batch.column(1).flatten().to_numpy()
                sizes = np.asarray(batch.column(1).value_lengths().fill_null(0), "i8")
                if len(ids) and (ids.min() < 0 or ids.max() >= len(widths) or not widths[ids].all()):
                    raise ValueError("an id is not in the vocabulary")
                ends = np.concatenate([[0], np.cumsum(widths[ids], dtype="i8")])
                at = np.repeat((begins[ids] - ends[:-1]).astype("i4"), widths[ids]) + np.arange(ends[-1], dtype="i4")
                offsets = ends[np.concatenate([[0], np.cumsum(sizes)])].astype("i4")
                decoded = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(text[at])])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), decoded], names=[id_col, ids_col, "decoded"])
    schema = T.StructType([*fields(rows, id_col, ids_col), T.StructField("decoded", T.BinaryType())])
    return rows.select(id_col, ids_col).mapInArrow(run, schema)


def digests(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, n_tokens, and the sha256 of the joined ids and of the decoded bytes."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return rows.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))
