"""Token ids as ORC tables.

One row per document: id, token ids (integer run-length encoded by the format), number of ids, the file's
ordinal and the number of ids before the document inside its file. Files are range partitions of the id
in ascending order, so the position of a document in the whole id sequence is the sum of the files before
it plus its place in the file. Row indexes and a Bloom filter on the id let a reader of a few documents
skip stripes; stripes are the unit of parallel reading.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.llm.common import fields, slices, text_list

CACHED_WORDS, CACHED_PIECES = 600_000, 250_000
ENCODED_ROWS = 400  # texts encoded at once
CONTROL_SEPARATORS = "\x1c\x1d\x1e\x1f"
ORC_OPTIONS = {"compression": "zstd", "orc.stripe.size": str(64 << 20), "orc.row.index.stride": "1000",
               "orc.bloom.filter.fpp": "0.01"}


#: How the vocabulary file prepares a text. With these, pieces of Latin words go straight to the model.
PREPARATION = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
         "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
PIECES = regex.compile(PREPARATION["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
#: Printable Latin characters that no normal form changes; without the capital dotted I, whose lower case is two.
LATIN = re.compile("[!-~\u00a1-\u00ac\u00ae-\u012f\u0131-\u024f]+")


def byte_characters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARACTERS = byte_characters()


class WordEncoder:
    """Encodes texts with a vocabulary that drops white space, so that words are independent of each other.

    Ids of the first ``CACHED_WORDS`` words and ``CACHED_PIECES`` pieces that this worker process meets are kept; frequent
    ones are among them. Latin words are cut into the pieces that the vocabulary's preparation gives, and pieces are
    shared between words; other words, and those with a special token's string, take the whole way. Results never
    depend on what is kept.
    """

    def __init__(self, tokenizer_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = Tokenizer(self.tokenizer.model)
        with open(tokenizer_file, encoding="utf-8") as f:
            given = json.load(f)
        self.plain = all(given[k] == v for k, v in PREPARATION.items()) and all(t["content"][:2] == "<|" for t in given["added_tokens"])
        self.known: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    @staticmethod
    def words(text: str) -> list[str]:
        """Split at Unicode white space. str.split() also splits at four control characters that are none."""
        if any(c in text for c in CONTROL_SEPARATORS):
            return regex.findall(r"[^\p{White_Space}]+", text)
        return text.split()

    @staticmethod
    def _encoded(tokenizer, words: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(words), 20_000):
            for e in tokenizer.encode_batch_fast(words[at:at + 20_000], add_special_tokens=False):
                ids = e.ids
                out.append(struct.pack(f"<{len(ids)}I", *ids))
        return out

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of words that are not known."""
        cut = {w: PIECES.findall(w.lower()) for w in words if self.plain and "<|" not in w and LATIN.fullmatch(w)}
        rest = [w for w in words if w not in cut]
        pieces = self.pieces
        new = list({p for x in cut.values() for p in x if p not in pieces})
        found = dict(zip(new, self._encoded(self.model, [p.encode().decode("latin-1").translate(BYTE_CHARACTERS) for p in new]), strict=True))
        if len(pieces) < CACHED_PIECES:
            pieces.update(found)
        out = {w: b"".join([found[p] if p in found else pieces[p] for p in x]) for w, x in cut.items()}
        out.update(zip(rest, self._encoded(self.tokenizer, rest), strict=True))
        if len(self.known) < CACHED_WORDS:
            self.known.update(out)
        return out

    def encode(self, texts: list[str], end_id: int | None) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        split = [self.words(t) for t in texts]
        parts = [list(map(self.known.get, words)) for words in split]
        holes = [[i for i, x in enumerate(found) if x is None] for found in parts]
        new = self.learn({words[i] for words, empty in zip(split, holes, strict=True) for i in empty})
        end = b"" if end_id is None else np.uint32(end_id).astype("<u4").tobytes()
        for words, found, empty in zip(split, parts, holes, strict=True):
            for i in empty:
                found[i] = new[words[i]]
        return [b"".join(found) + end for found in parts]


@functools.lru_cache(maxsize=2)
def word_encoder(tokenizer_file: str) -> WordEncoder:
    """One encoder per worker process, so that its known words serve all tasks that run there."""
    return WordEncoder(tokenizer_file)


def token_rows(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
               end_id: int | None = 1) -> DataFrame:
    """Columns id, ids, n_tokens, part, part_start; order and partitions are those of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = word_encoder(tokenizer_file), TaskContext.get().partitionId(), 0
        for batch in slices(batches, ENCODED_ROWS):
            packed = encoder.encode(text_list(batch.column(1)), end_id)
            sizes = np.array([len(x) // 4 for x in packed], "i8")
            ends = np.concatenate([[0], np.cumsum(sizes)])
            values = pa.array(np.frombuffer(b"".join(packed), "<i4"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.array(sizes),
                 pa.array(np.full(len(sizes), part, "i4")), pa.array(before + ends[:-1])],
                names=[id_col, "ids", "n_tokens", "part", "part_start"])
            before += int(ends[-1])
    return docs.select(id_col, text_col).mapInArrow(run, token_schema(docs, id_col))


def token_schema(docs: DataFrame, id_col: str) -> T.StructType:
    return T.StructType([*fields(docs, id_col), T.StructField("ids", T.ArrayType(T.IntegerType())),
                         T.StructField("n_tokens", T.LongType()), T.StructField("part", T.IntegerType()),
                         T.StructField("part_start", T.LongType())])


def write_token_ids(docs: DataFrame, path: str, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text",
                    end_id: int | None = 1, files: int | None = None) -> T.StructType:
    """Encode every whole text and write the ids as ORC in ascending id order; returns the table's schema.

    ``files`` (default: the session's shuffle partitions) bounds how much one task sorts and writes. Null ids
    come first, null and empty texts hold the end id only, rows with equal ids follow each other in an order
    fixed by their texts, and repeated rows are all kept. Other columns of ``docs`` are not read.
    """
    n = files or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(id_col), F.xxhash64(text_col), F.rand(7)]  # the last spreads many copies of one row over files
    placed = docs.select(id_col, text_col).repartitionByRange(n, *order).sortWithinPartitions(id_col, F.xxhash64(text_col))
    rows = token_rows(placed, tokenizer_file, id_col, text_col, end_id)
    rows.write.options(**ORC_OPTIONS).option("orc.bloom.filter.columns", id_col).mode("errorifexists").orc(path)
    return token_schema(docs, id_col)


def read_token_ids(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The written table with ``start``, the number of ids before each document in the whole sequence.

    The offsets hold one row per file, which is what bounds their broadcast.
    """
    rows = spark.read.schema(schema).orc(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("part").agg(F.sum("n_tokens").alias("_n")).select(
        "part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("part_start") + F.col("_offset")).drop("_offset")


def lookup(spark: SparkSession, path: str, schema: T.StructType, ids: list, id_col: str = "doc_id") -> DataFrame:
    """Rows of a few documents; the predicate reaches the file metadata, so other stripes are skipped."""
    return spark.read.schema(schema).orc(path).filter(F.col(id_col).isin(ids))


def id_checksums(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and the unsigned crc32 of the ids as little-endian 32-bit integers, from rows read back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            ends, values = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy().astype("<u4", copy=False)).cast("B")
            spans = zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(ends).astype("i8")),
                 pa.array([zlib.crc32(values[4 * a:4 * b]) for a, b in spans], pa.int64())],
                names=[id_col, "start", "n_tokens", "ids_crc32"])
    schema = T.StructType([*fields(rows, id_col), *(T.StructField(c, T.LongType()) for c in ("start", "n_tokens", "ids_crc32"))])
    return rows.select(id_col, "start", "ids").mapInArrow(run, schema)
