"""Alignment of two tokenizers over a corpus, each distinct text once.

Texts are shuffled by their full content, so copies become one row with a multiplicity. Every distinct text is encoded
with a byte-level vocabulary (A) and a piece vocabulary (B) and both are aligned by the bytes they cover. Texts are
packed into blocks: a block keeps its distinct id pairs once and, for every link of every text, the pair's number.
Pair counts are sums over (block, pair) rows weighted by multiplicity; counts go back to the blocks the same way, each
text adds up its links, and the measures are joined to ids by the text's digest. The block table is bucketed by block,
so texts and links are not shuffled again.
"""

from __future__ import annotations

import functools
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.llm.common import bucketed, text_list
from tickforge.llm.token_output import BYTE_CHARACTERS

BLOCK_CHARS = 4_000_000  # texts of a block, and so the memory of one cogroup; one longer text is a block of its own
SLICE_CHARS = 500_000  # texts aligned at once
RUN_CHARS = 50_000  # stretches encoded at once
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")

#: White space before which neither vocabulary can join anything (see ``Pair.cuts``), and a word.
STRETCH = re.compile("[ \n\t]*[^ \n\t]+|[ \n\t]+")
OTHER_SPACE = re.compile(r"[^\S \n\t]")
ANCHOR = " a"
#: Fixed value: how vocabulary A must cut a text for stretches to be independent of each other.
CUT = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
COMMA, BAR, SEMICOLON = b",|;"


def _ragged(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of all pieces given by begin and size, one after the other."""
    ends = np.cumsum(sizes, dtype="i8")
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Table:
    """Strings by number in one buffer."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(x) for x in strings], "i8")
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(strings), "u1")

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        return self.data[_ragged(self.begins[numbers], self.sizes[numbers])]


class Pair:
    """Both tokenizers and the bytes of their tokens.

    A stretch is a word with the white space before it. Where both vocabularies end their tokens at every such border,
    a text's tokens are those of its stretches one after the other, so a block encodes each distinct stretch once.
    Texts with other white space, or all texts if a vocabulary does not have that property, are one stretch.
    """

    def __init__(self, file_a: str, file_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(file_a), SentencePieceProcessor(model_file=file_b)
        self.a.encode_special_tokens = True
        back = {c: bytes([b]) for b, c in BYTE_CHARACTERS.items()}
        bytes_a = [b""] * (max(self.a.get_vocab(with_added_tokens=True).values()) + 1)
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            bytes_a[i] = b"".join(back[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.bytes_a = Table(bytes_a)
        self.bytes_b = Table([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        self.digits = Table([b"%d," % i for i in range(max(len(bytes_a), len(pieces)))])
        with open(file_a, encoding="utf-8") as f:
            given = json.load(f)
        self.cuts = (given["normalizer"] is None and given["pre_tokenizer"] == CUT
                     and not any(re.search("[\n\t ]|[^▁]▁", p) for p in pieces) and self._ids([" ﬁ  x", " Ĳ"], ANCHOR) is not None)

    def stretches(self, text: str) -> list[str]:
        """Of a text behind one space."""
        return STRETCH.findall(" " + text) if self.cuts and not OTHER_SPACE.search(text) else [" " + text]

    def _ids(self, run: list[str], anchor: str) -> tuple | None:
        """Ids of A and B for stretches that follow each other, with what each stretch has of them; None if one of the
        two does not give the bytes back. The anchor takes the space that B puts before what it encodes."""
        text = anchor + "".join(run)
        raw = np.frombuffer(text.encode(), "u1")
        ends = np.cumsum([len(x.encode()) for x in run]) + len(anchor)
        out = []
        for ids, table in ((self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.bytes_a),
                           (self.b.encode(text[1:], num_threads=1), self.bytes_b)):
            ids = np.array(ids, "i8")
            upto = np.cumsum(table.sizes[ids])
            if not len(ids) or upto[-1] != len(raw) or not np.array_equal(table.joined(ids), raw):
                return None
            cut = np.searchsorted(upto, np.concatenate([[len(anchor)], ends]), "right")
            out += [ids[cut[0]:], np.diff(cut)]
        return out[0], out[2], out[1], out[3]

    def encoded(self, stretches: list[str]) -> tuple[np.ndarray, ...]:
        """Ids of A and of B for all stretches, how many each stretch has of either, and whether it has any.

        White space at the end would join what follows in a run, so such a stretch makes a run of its own.
        """
        n = len(stretches)
        of_a, of_b, good = np.zeros(n, "i8"), np.zeros(n, "i8"), np.zeros(n, bool)
        ids_a, ids_b, order = [], [], []

        def take(run: list[int]) -> None:
            found = self._ids([stretches[i] for i in run], ANCHOR if self.cuts else "")
            if found is None:
                if len(run) > 1:
                    take(run[:len(run) // 2])
                    take(run[len(run) // 2:])
                return
            ids_a.append(found[0])
            ids_b.append(found[1])
            of_a[run], of_b[run], good[run] = found[2], found[3], True
            order.extend(run)

        run, chars = [], 0
        for i, s in enumerate(stretches):
            if not self.cuts or s[-1].isspace():
                take([i])
                continue
            run.append(i)
            chars += len(s)
            if chars >= RUN_CHARS:
                take(run)
                run, chars = [], 0
        if run:
            take(run)
        place = np.array(order, "i8")  # runs by themselves came before the run around them
        out = []
        for ids, sizes in ((ids_a, of_a), (ids_b, of_b)):
            begins = np.zeros(n, "i8")
            begins[place] = np.cumsum(sizes[place]) - sizes[place]
            out.append(np.concatenate([np.empty(0, "i8"), *ids])[_ragged(begins, sizes)])
        return out[0], out[1], of_a, of_b, good


@functools.lru_cache(maxsize=2)
def pair(file_a: str, file_b: str) -> Pair:
    return Pair(file_a, file_b)


def _packed(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, because their upper bytes are nearly constant."""
    return zstandard.compress(np.ascontiguousarray(numbers, "<u4").view("u1").reshape(-1, 4).T.tobytes())


def _unpacked(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(packed), "u1").reshape(4, -1).T).view("<u4").ravel()


class _Numbering(dict):
    """Stretches of one block as numbers in order of appearance."""

    def __missing__(self, stretch: str) -> int:
        number = self[stretch] = len(self)
        return number


def _aligned(tokens: Pair, a: np.ndarray, b: np.ndarray, text_ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links as codes, how many links and groups each text has, and the groups as bytes with their size by text.

    ``text_ends``: bytes up to the end of each text. Where a token of A or B ends, one link ends: between two such
    places there is one token of either. Where both end, a group ends.
    """
    end_a, end_b = np.cumsum(tokens.bytes_a.sizes[a]), np.cumsum(tokens.bytes_b.sizes[b])
    at = np.zeros((2, (text_ends[-1] if len(text_ends) else 0) + 1), bool)
    at[0, end_a] = at[1, end_b] = True
    links, groups = np.flatnonzero(at[0] | at[1]), np.flatnonzero(at[0] & at[1])
    codes = a[np.searchsorted(end_a, links)] * len(tokens.bytes_b.sizes) + b[np.searchsorted(end_b, links)]
    n_links, n_groups = (np.diff(np.searchsorted(x, text_ends, "right"), prepend=0) for x in (links, groups))

    # the ids of a group stand in order, those of A first
    upto_a, upto_b = np.searchsorted(end_a, groups, "right"), np.searchsorted(end_b, groups, "right")
    group_a, group_b = np.searchsorted(groups, end_a), np.searchsorted(groups, end_b)
    place_a = np.arange(len(a)) + np.concatenate([[0], upto_b])[group_a]
    place_b = np.arange(len(b)) + upto_a[group_b]
    ids = np.empty(len(a) + len(b), "i8")
    ids[place_a], ids[place_b] = a, b
    ends = np.cumsum(tokens.digits.sizes[ids])
    out = tokens.digits.joined(ids)
    out[ends[place_a[upto_a - 1]] - 1] = BAR
    out[ends[place_b[upto_b - 1]] - 1] = SEMICOLON
    last = np.cumsum(n_groups)[n_groups > 0] - 1  # nothing follows a text's last group
    closing = ends[place_b[upto_b[last] - 1]]
    sizes = np.zeros(len(text_ends), "i8")
    sizes[n_groups > 0] = np.diff(closing, prepend=0) - 1
    return codes, n_links, n_groups, np.delete(out, closing - 1), sizes


def _block(tokens: Pair, texts: list[str]) -> dict[str, np.ndarray]:
    """Per text: measures and groups; of the block: distinct codes, and each text's links as sorted numbers of those."""
    number, flat = _Numbering(), []
    for text in texts:
        found = tokens.stretches(text)
        flat.append(np.fromiter(map(number.__getitem__, found), "i8", len(found)))
    ids_a, ids_b, of_a, of_b, good = tokens.encoded(list(number))
    bytes_of = np.array([len(s.encode()) for s in number], "i8")
    begin_a, begin_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
    flat = [f if good[f].all() else f[:0] for f in flat]  # a text with a stretch that is not given back has no tokens
    chars = np.cumsum([len(t) + 1 for t in texts])
    cuts = np.unique(np.concatenate([[0], np.searchsorted(chars, np.arange(SLICE_CHARS, chars[-1], SLICE_CHARS)), [len(texts)]]))
    made: dict[str, list] = {m: [] for m in ("n_a", "n_b", "n_groups", "n_links", "codes", "groups", "sizes")}
    for first, last in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        some = np.concatenate(flat[first:last])
        ends = np.cumsum([len(f) for f in flat[first:last]])

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.concatenate([[0], np.cumsum(values)])[ends]
        a, b = ids_a[_ragged(begin_a[some], of_a[some])], ids_b[_ragged(begin_b[some], of_b[some])]
        codes, n_links, n_groups, groups, sizes = _aligned(tokens, a, b, per_text(bytes_of[some]))
        for m, x in zip(made, (np.diff(per_text(of_a[some]), prepend=0), np.diff(per_text(of_b[some]), prepend=0), n_groups, n_links, codes, groups, sizes),
                        strict=True):
            made[m].append(x)
    out = {m: np.concatenate(x) for m, x in made.items()}
    out["codes"], link = np.unique(out["codes"], return_inverse=True)
    # sums do not ask for the links' order; sorted within a text they pack better
    out["links"] = np.sort(np.repeat(np.arange(len(texts)), out["n_links"]) << 32 | link)
    return out


def blocks(texts: DataFrame, file_a: str, file_b: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """From (key, text, copies) one row per block: block, keys, measures and groups of each text, links (packed
    differences of sorted pair numbers), codes (of the distinct pairs) and weights (texts with the pair, by copies)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part, count = pair(file_a, file_b), TaskContext.get().partitionId(), 0
        keys, held, copies, chars = [], [], [], 0

        def close() -> pa.RecordBatch:
            made = _block(tokens, held)
            text, number = made["links"] >> 32, made["links"] & 0xFFFFFFFF
            first = np.diff(made["links"], prepend=-1) > 0  # a pair counts once per text
            weights = np.bincount(number[first], np.array(copies, "i8")[text[first]], len(made["codes"])).astype("i8")
            steps = np.where(np.diff(text, prepend=-1) > 0, number, np.diff(number, prepend=0))
            offsets = np.concatenate([[0], np.cumsum(made["sizes"])]).astype("i4")
            groups = pa.Array.from_buffers(pa.string(), len(held), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(made["groups"]))])
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
            return pa.RecordBatch.from_pydict({
                "block": pa.array([part << 32 | count]), "keys": one(pa.array(keys, pa.binary())), **{m: one(made[m]) for m in MEASURES[:4]},
                "groups": one(groups), "links": pa.array([_packed(steps)]), "codes": one(made["codes"]), "weights": one(weights)})

        for batch in batches:
            for key, text, n in zip(batch.column(0).to_pylist(), text_list(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                keys.append(key)
                held.append(text)
                copies.append(n)
                chars += len(text) + 1
                if chars >= block_chars:
                    yield close()
                    keys, held, copies, chars, count = [], [], [], 0, count + 1
        if keys:
            yield close()

    longs = T.ArrayType(T.LongType())
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("keys", T.ArrayType(T.BinaryType())),
                           *(T.StructField(m, longs) for m in MEASURES[:4]), T.StructField("groups", T.ArrayType(T.StringType())),
                           T.StructField("links", T.BinaryType()), T.StructField("codes", longs), T.StructField("weights", longs)])
    return texts.mapInArrow(run, schema)


def pair_counts(weighted: DataFrame, width: int) -> DataFrame:
    """From (code, weight): code, n (documents that hold the pair linked) and best (no pair of its A id has more).

    An A id has at most as many pairs as B has ids, which bounds the window.
    """
    counts = weighted.groupBy("code").agg(F.sum("weight").alias("n"))
    of_a = Window.partitionBy(F.expr(f"code div {width}"))
    return counts.select("code", "n", (F.col("n") == F.max("n").over(of_a)).alias("best"))


def align(docs: DataFrame, file_a: str, file_b: str, id_col: str = "doc_id", text_col: str = "text",
          kept: Callable[[Column], Column] = lambda groups: groups, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """id, the measures n_a, n_b, n_groups, n_links, n_best, count_sum, and groups, for every row.

    Groups are the ids between common token ends, ``a1,a2|b1;a3|b2,b3``; ``kept`` says what of them is stored (by
    default all of it). A pair's count is the number of rows that hold it linked; n_best counts the links whose pair
    has its A id's highest count, count_sum adds up the counts of all links.

    Null and empty texts, and texts that a tokenizer does not give back byte for byte behind a space, hold no tokens:
    zeros and empty groups, and ``kept`` does not apply. Repeated rows each count and each get their row, rows that
    share an id keep their own text's measures. An empty table gives an empty table; other columns are not read.
    """
    key = F.unhex(F.sha2(F.col(text_col), 256))
    texts = docs.select(F.col(text_col).alias("text")).filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("copies"))
    made = blocks(texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "text", "copies"), file_a, file_b, block_chars)
    made = made.withColumn("groups", F.transform("groups", lambda g: F.when(g != "", kept(g)).otherwise(F.lit(""))))
    held = bucketed(made, "block", "aligned_blocks")
    rows = held.select("block", F.explode(F.arrays_zip("codes", "weights")).alias("x")).select(
        "block", F.col("x.codes").alias("code"), F.col("x.weights").alias("weight"))
    width = pair(file_a, file_b).b.vocab_size()
    back = rows.select("block", "code").join(pair_counts(rows, width), "code").select(F.col("block").alias("of_block"), "code", "n", "best")

    def add_up(block: pa.Table, known: pa.Table) -> pa.Table:
        code = known["code"].to_numpy()
        order = np.argsort(code)
        n, best = known["n"].to_numpy()[order], known["best"].to_numpy()[order].astype("i8")
        sizes = np.array(block["n_links"][0].as_py(), "i8")
        steps = _unpacked(block["links"][0].as_py()).astype("i8")
        ends = np.cumsum(sizes)
        total = np.cumsum(steps)  # over the whole block; what came before a text is taken off again
        number = total - np.repeat(np.concatenate([[0], total])[ends - sizes], sizes)

        def per_text(values: np.ndarray) -> pa.Array:
            upto = np.concatenate([[0], np.cumsum(values)])
            return pa.array(upto[ends] - upto[ends - sizes])
        return pa.table({"key": block["keys"].combine_chunks().flatten(), **{m: block[m].combine_chunks().flatten() for m in MEASURES[:4]},
                         "n_best": per_text(best[number]), "count_sum": per_text(n[number]), "groups": block["groups"].combine_chunks().flatten()})

    schema = T.StructType([T.StructField("key", T.BinaryType()), *(T.StructField(m, T.LongType()) for m in MEASURES),
                           T.StructField("groups", T.StringType())])
    known = held.select("block", "keys", *MEASURES[:4], "groups", "links").groupBy("block").cogroup(back.groupBy("of_block")).applyInArrow(add_up, schema)
    return docs.select(F.col(id_col).alias("_id"), key.alias("key")).join(known, "key", "left").select(
        F.col("_id").alias(id_col), *(F.coalesce(m, F.lit(0)).cast("long").alias(m) for m in MEASURES),
        F.coalesce("groups", F.lit("")).alias("groups"))
