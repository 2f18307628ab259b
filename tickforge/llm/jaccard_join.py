"""Exact Jaccard join of documents as word-shingle sets, in metric space.

The Jaccard distance is a metric, so two documents within ``1 - MIN_JACCARD`` = 1/4 of each other are at most that
far apart in their distance to any third one, the pivot.

* Equal sets are one node. A set is a compact blob of sorted shingle hashes; the table of blobs is shuffled once, by
  node, and bucketed so that no join on the node moves it again.
* Pivots: among the nodes that share one of their smallest shingles, the one whose smallest shingles are the most
  common leads, since it lies in the middle of its copies; a node that follows nobody is a pivot, and the others go to
  the pivot they share most of those shingles with. Its Voronoi region is every follower whose verified distance is at
  most 1/4. All other nodes are regions of their own.
  Followers out of reach of their pivot that are still many get a middle of their own, again while that takes an
  eighth of them: copies of a text that is not in the table, or several families behind one pivot.
* Windows: a node shares at least three quarters of its shingles with anything it is linked to, so counting the
  shingles that it shares with a foreign region, under a common bound of the hash, names without loss every
  region it may reach. The distance to that region's pivot is then computed: within 1/4 it is a link; beyond the
  region's radius plus 1/4 the triangle inequality rules out all its members; in between the node is a boundary
  document, replicated into the region and compared with the members whose own distance to the pivot is within
  1/4 of its own.
* Recursion: shingles of very many regions are not counted. That leaves too little to count for nodes that consist of
  such shingles nearly alone. A linked pair of those has a smaller node of which under a seventh is anything else
  (the intersection is at least 3/7 of the two sizes together); such nodes with the same shingles are linked to each
  other and so have met in few regions already. They are the targets of a further join, on all shingles and with
  eight times the limit, until no node is left without an exact count.

A group of copies of any size meets as one node or one region, so links inside it cost one comparison a node.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.llm.common import bucketed, bytes_list, fields, lean, slices, spare, staged
from tickforge.llm.words import windows

SHINGLE_WORDS = 5
MIN_PERCENT = 75  # of the union, in the intersection
RADIUS = 1 - MIN_PERCENT / 100
BITS, BYTES = 40, 5  # of a shingle's 64-bit hash, kept to compare sets: two of n shingles differ by chance in n^2 / 2^40 cases
ANCHORS = 16  # smallest shingles by which pivots are found
LEAST_ANCHORS = 8  # of them, or half of all for a smaller set, that a follower shares with its pivot
REGIONS = 32  # regions of a shingle that is still counted
TARGETS = 256  # such regions in the last steps, where few are left; times eight while any node is without an exact count
SINGLE, REGION, MEMBER = 0, 1, 2  # roles of a row, in the order in which a shingle's rows follow each other
KEPT_COUNTS = 400_000  # counts a task sums before it passes them on
LEAST_PACKS = 64  # groups of nodes whose counts are passed on together, or as many as there are shuffle partitions
ROWS = 500  # rows unpacked at once
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _distinct(ordered: np.ndarray) -> np.ndarray:
    """A sorted array without repeats."""
    return ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered


def shingles(raw: bytes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text; one for the whole sequence if it has fewer words."""
    words = raw.translate(LOWER).split()
    if not words:
        return np.empty(0, "u8")
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype("u8")
    found = windows(hashes, min(SHINGLE_WORDS, len(words)))
    if len(words) < SHINGLE_WORDS:
        found = found ^ np.uint64(len(words) << 56)  # another hash than that of any longer run
    return _distinct(np.sort(found))


def _blob(hashes: np.ndarray, packer: zstandard.ZstdCompressor) -> bytes:
    """The upper bits of sorted hashes, byte by byte, because the first byte hardly varies along them."""
    kept = np.ascontiguousarray(hashes >> np.uint64(64 - BITS))
    return packer.compress(kept.view("u1").reshape(-1, 8)[:, :BYTES].T.tobytes())


def _unblob(blob: bytes) -> np.ndarray:
    raw = zstandard.decompress(blob)
    wide = np.zeros((len(raw) // BYTES, 8), "u1")
    wide[:, :BYTES] = np.frombuffer(raw, "u1").reshape(BYTES, -1).T
    return wide.view("<u8").ravel()


def _share(n: float) -> float:
    """Part of the hash range below which a set of n shingles counts: a quarter, which a linked set may lack, and so
    much more that chance seldom leaves less. Falls with n."""
    return min(1.0, 1 - MIN_PERCENT / 100 + 0.01 + 1.2 / max(n, 1) ** 0.5)


def _below(hashes: np.ndarray, share: float) -> int:
    return len(hashes) if share >= 1 else int(np.searchsorted(hashes, np.uint64(share * 2.0 ** BITS)))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def _node(found: np.ndarray) -> int | None:
    return _signed(xxhash.xxh3_64_intdigest(found.tobytes())) if len(found) else None


def document_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document: id, _text (hash of the text), n_shingles, node (hash of the set, null for none), m (shingles
    that the set counts at the first level) and blob. Texts are read and cut once.

    A task gives the blob of a set with the first of its copies alone, so a set has at most one per task.
    """
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, seen = zstandard.ZstdCompressor(), set()
        for batch in slices(batches, ROWS):
            rows = []
            for raw in bytes_list(batch.column(2)):
                found = shingles(raw)
                node, n = _node(found), len(found)
                if node is None or node in seen:
                    rows.append((n, node, None, None))
                else:
                    seen.add(node)
                    rows.append((n, node, _below(found >> np.uint64(64 - BITS), _share(n)), _blob(found, packer)))
            if len(seen) > 1_000_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows], pa.binary())],
                names=[id_col, "_text", "n_shingles", "node", "m", "blob"])
    schema = T.StructType([*fields(docs, id_col), *(T.StructField(c, T.LongType()) for c in ("_text", "n_shingles", "node", "m")),
                           T.StructField("blob", T.BinaryType())])
    return docs.select(id_col, F.xxhash64(text_col).alias("_text"), text_col).mapInArrow(run, schema)


def shingle_sets(rows: DataFrame) -> DataFrame:
    """One row per node of ``document_sets``: node, n (shingles), m and blob; bucketed by node."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sets = rows.filter("blob is not null").select("node", F.col("n_shingles").alias("n"), "m", "blob").repartition(n, "node")
    return bucketed(sets.dropDuplicates(["node"]), "node", "shingle_sets", "uncompressed")


def _flat(column: pa.Array) -> list[np.ndarray]:
    return [_unblob(b) for b in column.to_pylist()]


def pivots(sets: DataFrame) -> DataFrame:
    """(node, pivot): followers and the pivot they are to be measured against."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            first = [h[:ANCHORS].astype("i8") for h in _flat(batch.column(1))]
            nodes = np.repeat(batch.column(0).to_numpy(), [len(x) for x in first])
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.concatenate(first), pa.int64())], names=["node", "anchor"])
    anchors = staged(sets.select("node", "blob").mapInArrow(run, "node long, anchor long"), "anchors")
    common = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("often")).filter("often > 1").select(F.col("anchor").alias("at"), "often")
    shared = staged(anchors.join(staged(common, "common-anchors"), F.col("anchor") == F.col("at")).select("node", "anchor", "often"), "shared-anchors")
    weight = shared.groupBy("node").agg(F.sum("often").alias("weight")).select(F.col("node").alias("of"), "weight")
    leaders = shared.join(weight, F.col("node") == F.col("of")).groupBy("anchor").agg(F.max_by("node", F.struct("weight", "node")).alias("leader"))
    leaders = staged(leaders.select(F.col("anchor").alias("at"), "leader"), "leaders")
    counted = shared.join(leaders, F.col("anchor") == F.col("at")).filter("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("c"))
    sizes = sets.select(F.col("node").alias("of"), "n")
    follows = staged(counted.join(sizes, F.col("node") == F.col("of")).filter(
        F.col("c") >= F.least(F.lit(LEAST_ANCHORS), F.ceil(F.col("n") / 2))).select("node", "leader", "c"), "follows")
    roots = follows.select(F.col("leader").alias("root")).distinct().join(
        follows.select(F.col("node").alias("root")).distinct(), "root", "left_anti")
    to_root = follows.join(roots, F.col("leader") == F.col("root"), "left_semi")
    chosen = staged(to_root.groupBy("node").agg(F.max_by("leader", F.struct("c", -F.col("leader"))).alias("pivot")), "pivots")
    return central(chosen, sets)


def central(chosen: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, pivot) where every group of more than ``REGIONS`` followers gets its middle for a pivot; the old pivot follows it."""
    large = chosen.groupBy(F.col("pivot").alias("old")).agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > REGIONS).select("old")
    inside = chosen.join(large, F.col("pivot") == F.col("old")).select(F.col("node").alias("of"), "old").unionByName(
        large.select(F.col("old").alias("of"), "old"))
    middle = _middles(inside, sets)
    everyone = chosen.unionByName(middle.select(F.col("group").alias("node"), F.col("group").alias("pivot")))
    return everyone.join(middle, F.col("pivot") == F.col("group"), "left").select("node", F.coalesce("middle", "pivot").alias("pivot")).filter("node <> pivot")


def _middles(inside: DataFrame, sets: DataFrame) -> DataFrame:
    """(group, middle): of each group (``old``) of nodes (``of``) the one whose shingles are the most common in the group
    for its size. All shingles are counted, which the few smallest cannot replace: the middle of many copies is the one
    that most of them lie within reach of. Its score is the mean intersection with the group over the mean union."""
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            held = _flat(batch.column(2))
            sizes = [len(x) for x in held]
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(batch.column(i).to_numpy(), sizes)) for i in range(2)),
                                              pa.array(np.concatenate(held).astype("i8"))], names=["of", "old", "shingle"])
    held = sets.join(inside, F.col("node") == F.col("of")).select("of", "old", "blob").mapInArrow(run, "of long, old long, shingle long")
    often = held.groupBy(F.col("old").alias("group"), F.col("shingle").alias("at")).agg(F.count(F.lit(1)).alias("often"))
    met = held.join(often, (F.col("old") == F.col("group")) & (F.col("shingle") == F.col("at"))).groupBy("old", "of").agg(
        F.sum("often").alias("inter"), F.count(F.lit(1)).alias("n"))
    met = staged(met, "in-groups")
    groups = met.groupBy(F.col("old").alias("group")).agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("total"))
    weight = met.join(groups, F.col("old") == F.col("group")).select("group", "of", (F.col("inter") / (F.col("c") * F.col("n") + F.col("total") - F.col("inter"))).alias("weight"))
    return staged(weight.groupBy("group").agg(F.max_by("of", F.struct("weight", "of")).alias("middle")), "middles")


def followers_of(sets: DataFrame) -> list[DataFrame]:
    """Measured pairs of nodes and their pivots, by rounds.

    Nodes out of reach of their pivot that are still more than ``REGIONS`` are a group again and get a middle of their
    own: copies of a text that is not in the table, or several families behind one pivot. A group goes on while a round
    takes an eighth of it, so rounds are few; what no round takes are regions of one node, which the counts join exactly.
    """
    rounds = [staged(measured(pivots(sets).select(F.col("node").alias("a"), F.col("pivot").alias("b")), sets), "followers")]
    groups = rounds[0].groupBy(F.col("b").alias("old")).agg(F.count_if(~F.expr(IS_LINK)).alias("c"))
    while True:
        groups = staged(groups.filter(F.col("c") > REGIONS).select("old"), "groups")
        if groups.isEmpty():
            return rounds
        apart = rounds[-1].filter(f"not ({IS_LINK})").select(F.col("a").alias("of"), "b").join(groups, F.col("b") == F.col("old")).select("of", "old")
        apart = staged(apart, "out-of-reach")
        follow = apart.join(_middles(apart, sets), F.col("old") == F.col("group")).filter("of <> middle")
        rounds.append(staged(measured(follow.select(F.col("of").alias("a"), F.col("middle").alias("b")), sets), "followers"))
        groups = rounds[-1].groupBy(F.col("b").alias("old")).agg(
            F.count_if(~F.expr(IS_LINK)).alias("c"), F.count(F.lit(1)).alias("all")).filter("8 * (all - c) >= all")


def _with_blobs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (columns a, b and any others) with the blobs of both, others first.

    Blobs of a stay where they are bucketed; those of b that occur are copied once, and both sides of the second
    join are plain shuffles, so that a b with very many partners can be split.
    """
    blobs = sets.select("node", "blob")
    others = [c for c in pairs.columns if c not in ("a", "b")]

    def of(side: str) -> DataFrame:
        wanted = pairs.select(F.col(side).alias("wanted")).distinct()
        return blobs.join(wanted, F.col("node") == F.col("wanted"), "left_semi")
    right = staged(of("b").select(F.col("node").alias("_b"), F.col("blob").alias("_right")), "pivot-blobs")
    left = pairs.join(of("a").select(F.col("node").alias("_a"), F.col("blob").alias("_left")), F.col("a") == F.col("_a"))
    return left.join(right, F.col("b") == F.col("_b")).select(*others, "a", "b", "_left", "_right")


def _both(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The two sets of each row; rows of one b follow each other."""
    last, other = None, None
    for x, y in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
        if y != last:
            last, other = y, _unblob(y)
        yield _unblob(x), other


def _held(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which values of one sorted array the other, which is not empty, has as well."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with ``inter``, ``na`` and ``nb``: sizes of intersection and sets."""
    joined = _with_blobs(pairs, sets)
    names = [*joined.columns[:-2], "inter", "na", "nb"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            sizes = [(int(_held(x, y).sum()), len(x), len(y)) for x, y in _both(batch)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *(pa.array([r[i] for r in sizes], pa.int64()) for i in range(3))], names=names)
    return joined.mapInArrow(run, T.StructType([*joined.schema.fields[:-2], *(T.StructField(c, T.LongType()) for c in names[-3:])]))


def outside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """A row per shingle of a that b lacks: the columns of ``pairs`` and ``shingle``."""
    joined = _with_blobs(pairs, sets)
    names = [*joined.columns[:-2], "shingle"]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            extra = [x[~_held(x, y)] for x, y in _both(batch)]
            repeat = pa.array(np.repeat(np.arange(len(extra)), [len(e) for e in extra]))
            yield pa.RecordBatch.from_arrays([*(c.take(repeat) for c in batch.columns[:-2]), pa.array(np.concatenate(extra).astype("i8"))],
                                             names=names)
    return joined.mapInArrow(run, T.StructType([*joined.schema.fields[:-2], T.StructField("shingle", T.LongType())]))


IS_LINK = f"100 * inter >= {MIN_PERCENT} * (na + nb - inter)"
DISTANCE = "1 - inter / (na + nb - inter)"


def _all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _shown(sets: DataFrame, everything: bool, role: int) -> DataFrame:
    """(shingle, role, label, node, info) from ``sets`` (node, blob, label); a null label makes the node a single.

    A node shows what its smallest possible partner counts, and counts what its largest possible one shows. ``info``
    is twice the node's size, plus one where it counts the shingle.
    """
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            held = _flat(batch.column(1))
            n = np.array([len(h) for h in held])
            shown = np.array([len(h) if everything else _below(h, _share(len(h) * MIN_PERCENT / 100)) for h in held])
            own = np.array([len(h) if everything else _below(h, _share(len(h))) for h in held])
            at = np.repeat(np.arange(len(n)), shown)
            counted = np.arange(len(at)) - np.repeat(np.cumsum(shown) - shown, shown) < own[at]
            repeat = pa.array(at)
            label = batch.column(2).take(repeat)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([h[:k] for h, k in zip(held, shown, strict=True)]).astype("i8")),
                 pa.array(np.where(label.is_null().to_numpy(zero_copy_only=False), 0, role).astype("i4")), label,
                 batch.column(0).take(repeat), pa.array(2 * n[at] + counted)], names=["shingle", "role", "label", "node", "info"])
    return sets.select("node", "blob", "label").mapInArrow(run, "shingle long, role int, label long, node long, info long")


def _regions_of(shown: DataFrame) -> DataFrame:
    """One row per shingle and region instead of one per node; ``info`` is the largest size, ``node`` the smallest."""
    spans = shown.withColumn("label", F.coalesce("label", "node")).groupBy("shingle", "label").agg(
        F.min(F.expr("info div 2")).alias("node"), F.max(F.expr("info div 2")).alias("info"))
    return spans.select("shingle", F.lit(REGION).alias("role"), "label", "node", "info")


def _shared(rows: DataFrame, limit: int | None = None, whole: bool = False) -> DataFrame:
    """(node, label, c): the node shares c shingles with that foreign region; without label, c shingles that are not
    counted because more than ``limit`` regions have them.

    The rows of a shingle follow each other, its regions and singles first, so that nothing is held but ``limit`` of
    those. Only regions that could hold a partner of the node's size count. Where ``whole`` sets are shown, a link
    needs three sevenths of both sizes together: pairs are left out that miss it with all uncounted shingles added, the
    region's smallest node taken for the other.
    """
    limit = limit or REGIONS
    packs = max(LEAST_PACKS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}  # by the numbers of node and label (0: uncounted) in one integer
        number: dict[int, int] = {}
        spans: dict[int, tuple[int, int]] = {}  # by number of the label
        smallest: dict[int, int] = {}  # size of a label's smallest node met, by its number
        sizes: dict[int, int] = {}  # of nodes that search, by their number
        singles: list[tuple[int, int]] = []
        last, open_shingle, many = None, None, False

        def numbered(x: int) -> int:
            return number.setdefault(x, len(number) + 1)

        def flush() -> pa.RecordBatch:
            """Rows of all that a task has counted for a pack of nodes: rows per pair, or per node, would be as many in
            every task again, since each task meets most nodes."""
            size = len(number) + 1
            names, n, least = np.zeros(size, "i8"), np.zeros(size, "i4"), np.zeros(size, "i4")
            names[1:] = np.fromiter(number, "i8", len(number))
            for column, held in ((n, sizes), (least, smallest)):
                column[np.fromiter(held, "i8", len(held))] = np.fromiter(held.values(), "i8", len(held))
            keys, c = np.fromiter(counts, "i8", len(counts)), np.fromiter(counts.values(), "i4", len(counts))
            counts.clear()
            pack = names[keys >> 32] % packs
            order = np.lexsort((keys, pack))
            keys, c, pack = keys[order], c[order], pack[order]
            node, label = keys >> 32, keys & 0xFFFFFFFF
            starts = np.concatenate([[0], np.flatnonzero(pack[1:] != pack[:-1]) + 1])
            offsets = pa.array(np.append(starts, len(pack)).astype("i4"))
            columns = names[node], n[node], names[label], np.where(label == 0, -c, c), least[label]
            return pa.RecordBatch.from_arrays([pa.array(pack[starts]), *(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in columns)],
                                              names=["pack", "nodes", "n", "labels", "shared", "least"])

        def searched(node: int, label: int, n: int) -> None:
            key, label = numbered(node) << 32, numbered(label)
            sizes[key >> 32] = n
            if many:
                counts[key] = counts.get(key, 0) + 1
                return
            for other, (low, high) in spans.items():
                if other != label and 100 * high >= MIN_PERCENT * n and MIN_PERCENT * low <= 100 * n:
                    counts[key | other] = counts.get(key | other, 0) + 1

        def told() -> None:
            """Singles are regions and search; they wait until all regions are known."""
            for node, n in singles:
                searched(node, node, n)
            singles.clear()

        for batch in batches:
            shingle = batch.column(0).to_numpy()
            change = np.flatnonzero(shingle[1:] != shingle[:-1]) + 1
            starts, ends = np.concatenate([[0], change]), np.concatenate([change, [len(shingle)]])
            look = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(shingle)))
            rows_of = np.concatenate([np.arange(a, b) for a, b in zip(starts[look], ends[look], strict=True)])
            kept = batch.take(pa.array(rows_of))  # rows alone with their shingle, here and in the next batch, share nothing
            for row in zip(*(c.to_pylist() for c in kept.columns), strict=True):
                if row == last:
                    continue  # two equal shortened hashes of one set
                last = row
                key, role, label, node, info = row
                if key != open_shingle:
                    told()
                    open_shingle, many = key, False
                    spans.clear()
                    if len(number) > KEPT_COUNTS:  # no shingle is open that uses the numbers
                        if counts:
                            yield flush()
                        for x in (number, smallest, sizes):
                            x.clear()
                if role == MEMBER:
                    told()
                    if info & 1:
                        searched(node, node if label is None else label, info >> 1)
                    continue
                if not many:
                    at = numbered(node if label is None else label)
                    low, _ = spans[at] = (node, info) if role == REGION else (info >> 1, info >> 1)
                    smallest[at] = min(low, smallest.get(at, low))
                if role == SINGLE and info & 1:
                    singles.append((node, info >> 1))
                if len(spans) > limit:
                    many = True
                    spans.clear()
                if many:
                    told()
            if len(counts) > KEPT_COUNTS:
                yield flush()
        told()
        if counts:
            yield flush()

    @lean
    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # of one pack; its rows follow each other

        def told() -> Iterator[pa.RecordBatch]:
            node, n, label, c, low = (np.concatenate([x.column(i).flatten().to_numpy() for x in held]) for i in range(1, 6))
            held.clear()
            none = np.flatnonzero(c < 0)
            none = none[np.argsort(node[none], kind="stable")]
            first = _starts(node[none])
            bare, uncounted = node[none][first], -np.add.reduceat(c[none], first, dtype="i8") if len(first) else np.empty(0, "i8")
            some = np.flatnonzero(c > 0)
            some = some[np.lexsort((label[some], node[some]))]
            first = _starts(node[some], label[some])
            pairs, both = some[first], np.add.reduceat(c[some], first, dtype="i8") if len(first) else np.empty(0, "i8")
            if whole and len(first):
                more = np.zeros(len(pairs), "i8")
                if len(bare):
                    at = np.minimum(np.searchsorted(bare, node[pairs]), len(bare) - 1)
                    more = np.where(bare[at] == node[pairs], uncounted[at], 0)
                fit = (100 + MIN_PERCENT) * (both + more) >= MIN_PERCENT * (n[pairs].astype("i8") + np.minimum.reduceat(low[some], first))
                pairs, both = pairs[fit], both[fit]
            nulls = np.arange(len(bare) + len(pairs)) < len(bare)
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([bare, node[pairs]])), pa.array(np.concatenate([bare, label[pairs]]), mask=nulls),
                 pa.array(np.concatenate([uncounted, both]))], names=["node", "label", "c"])
            yield from slices([out], ROWS * 20)

        last = None
        for batch in batches:
            pack = batch.column(0).to_numpy()
            for start, end in zip(first := _starts(pack), [*first[1:], len(pack)], strict=True):
                if held and pack[start] != last:
                    yield from told()
                last = pack[start]
                held.append(batch.slice(start, end - start))
        if held:
            yield from told()

    met = rows.repartition("shingle").sortWithinPartitions("shingle", "role", "label", "node")
    parts = met.mapInArrow(run, "pack long, nodes array<long>, n array<int>, labels array<long>, shared array<int>, least array<int>")
    return parts.repartition("pack").sortWithinPartitions("pack").mapInArrow(add_up, "node long, label long, c long")


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins in columns that are sorted."""
    if not len(columns[0]):
        return np.empty(0, "i8")
    return np.concatenate([[0], np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in columns])) + 1])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge (a, b): the graph is contracted to each node's smallest neighbour until no
    edge is left. Nodes are hashes, so a constant part of them goes each time; every round is a table."""
    edges, steps = staged(edges.select("a", "b").distinct(), "edges"), []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = staged(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "contraction")
        steps.append(step)
        for side in ("a", "b"):
            edges = edges.join(step, F.col(side) == F.col("node")).drop(side, "node").withColumnRenamed("root", side)
        edges = staged(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if not steps:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    label = steps[-1]
    for step in reversed(steps[:-1]):
        further = label.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        label = staged(step.join(further, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root")), "labels")
    return label


def _towards_pure(sets: DataFrame, nodes: DataFrame, labelled, left: DataFrame) -> list[DataFrame]:
    """Measured pairs of what is still left with the regions of nodes that consist of uncounted shingles nearly alone.

    Every linked pair that is not found yet has such a node for its smaller part. The limit grows until every node
    that searches has an exact count.
    """
    pure = sets.join(left.filter("seventh <= 0").select(F.col("_r").alias("_p")), F.col("node") == F.col("_p"), "left_semi")
    targets = staged(_regions_of(_shown(labelled(pure), True, MEMBER)), "targets")
    rest, found, limit = staged(left.filter("quarter <= 0").select("_r"), "rest"), [], TARGETS
    while not rest.isEmpty() and not targets.isEmpty():
        some = labelled(sets.join(rest, F.col("node") == F.col("_r"), "left_semi"))
        shown = _shown(some, True, MEMBER).withColumn("role", F.lit(MEMBER))
        shared = staged(_shared(shown.unionByName(targets), limit, whole=True), "shared")
        uncounted = shared.filter("label is null").select(F.col("node").alias("_h"), F.col("c").alias("h"))
        state = staged(rest.join(nodes, F.col("_r") == F.col("node")).join(uncounted, F.col("node") == F.col("_h"), "left").selectExpr(
            "_r", f"n - coalesce(h, 0) - n * {100 - MIN_PERCENT} div 100 as quarter"), "left")
        counted = shared.filter("label is not null").join(state, F.col("node") == F.col("_r")).filter("quarter >= 1 and c >= quarter")
        found.append(staged(measured(counted.select(F.col("node").alias("a"), F.col("label").alias("b")), sets), "measured"))
        rest, limit = staged(state.filter("quarter <= 0").select("_r"), "rest"), 8 * limit
    return found


def links(sets: DataFrame) -> DataFrame:
    """(a, b): verified links between nodes whose closure is that of all links. ``sets`` has one row per node."""
    nodes = sets.select("node", "n", "m")
    followers = _all(followers_of(sets))
    members = followers.filter(IS_LINK).selectExpr("a", "b", "na", "inter", f"{DISTANCE} as distance")
    own = members.select(F.col("a").alias("_n"), F.col("b").alias("label"))
    labels = staged(own.unionByName(own.select(F.col("label").alias("_n"), "label").distinct()), "regions")
    radius = members.groupBy(F.col("b").alias("region")).agg(F.max("distance").alias("radius"))

    def labelled(some: DataFrame) -> DataFrame:
        return some.join(labels, F.col("node") == F.col("_n"), "left").select("node", "blob", "label")

    def counts(shown: DataFrame, targets: DataFrame, have: DataFrame, whole: bool) -> tuple[DataFrame, DataFrame]:
        """What nodes share, and what is left of the shingles they count beyond those a linked set may lack: a quarter,
        or a seventh for a partner of at least the same size. ``have``: node, n, m."""
        shared = staged(_shared(shown.unionByName(targets), whole=whole), "shared")
        uncounted = shared.filter("label is null").select(F.col("node").alias("_h"), F.col("c").alias("h"))
        left = have.join(uncounted, F.col("node") == F.col("_h"), "left").selectExpr(
            "node as _r", f"m - coalesce(h, 0) - n * {100 - MIN_PERCENT} div 100 as quarter", "m - coalesce(h, 0) - n div 7 as seventh")
        left = staged(left, "left")
        least = left.selectExpr("_r", "case when quarter >= 1 then quarter else greatest(1, seventh) end as least")
        counted = shared.filter("label is not null").join(least, F.col("node") == F.col("_r")).filter("c >= least")
        return left, measured(counted.select(F.col("node").alias("a"), F.col("label").alias("b")), sets)

    # all nodes, on the shingles below a bound: singles are regions and search at once, members search
    in_regions = _shown(sets.join(labels, F.col("node") == F.col("_n")).select("node", "blob", "label"), False, MEMBER)
    left, near = counts(_shown(labelled(sets), False, MEMBER), _regions_of(in_regions), nodes, False)
    found = [staged(near, "measured")]

    # those with too little left, among themselves and on all shingles
    rest = staged(left.filter("quarter <= 0").select("_r"), "rest")
    if not rest.isEmpty():
        some = sets.join(rest, F.col("node") == F.col("_r"), "left_semi")
        whole = nodes.join(rest, F.col("node") == F.col("_r"), "left_semi").selectExpr("node", "n", "n as m")
        in_regions = _shown(some.join(labels, F.col("node") == F.col("_n")).select("node", "blob", "label"), True, MEMBER)
        left, near = counts(_shown(labelled(some), True, MEMBER), _regions_of(in_regions), whole, True)
        found.append(staged(near, "measured"))
        found += _towards_pure(sets, nodes, labelled, left)

    all_found = _all(found)
    edges = staged(members.select("a", "b").unionByName(all_found.filter(IS_LINK).select("a", "b")), "links")
    near = all_found.filter(f"not ({IS_LINK})").withColumn("distance", F.expr(DISTANCE)).join(radius, F.col("b") == F.col("region")).filter(
        F.col("distance") <= F.col("radius") + RADIUS + 1e-9).select("a", "b", "na", "inter", "distance")
    near = staged(near, "boundary")
    if near.isEmpty():
        return edges
    # boundary documents that are not connected to the region by other links yet
    roots = components(edges)
    of_a, of_b = (roots.select(F.col("node").alias(f"_{x}"), F.col("root").alias(f"root_{x}")) for x in "ab")
    apart = staged(near.join(of_a, F.col("a") == F.col("_a"), "left").join(of_b, F.col("b") == F.col("_b"), "left").filter(
        F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(near.columns), "apart")
    if apart.isEmpty():
        return edges
    pairs = _boundary_pairs(apart, members, sets)
    exact = measured(pairs, sets)
    return staged(edges.unionByName(exact.filter(IS_LINK).select("a", "b")), "links")


def _boundary_pairs(apart: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): boundary documents and the members of the region that they can be linked to.

    Both distances to the pivot are known, so is what each shares with it. The two can share no more of the pivot's
    shingles than the lesser of that; the rest of the intersection a link needs lies outside the pivot. Of what the
    boundary document has there, so many must be shared that one of them is left when as many less one, the most common
    of the region, are put aside: only the others are looked up.
    """
    inside = members.join(apart.select(F.col("b").alias("_b")).distinct(), F.col("b") == F.col("_b"), "left_semi")
    need = F.expr("(3 * (nx + ny) + 6) div 7 - least(ix, iy)")
    fits = (F.col("dx") - F.col("dy") <= RADIUS + 1e-9) & (100 * F.col("nx") >= MIN_PERCENT * F.col("ny")) & (100 * F.col("ny") >= MIN_PERCENT * F.col("nx"))

    def named(rows: DataFrame, x: str) -> DataFrame:
        return rows.select(F.col("a").alias(x), F.col("b").alias(f"r{x}"), F.col("na").alias(f"n{x}"), F.col("inter").alias(f"i{x}"),
                           F.col("distance").alias(f"d{x}"), *([F.col("shingle").alias(f"s{x}")] if "shingle" in rows.columns else []))
    same = F.col("rx") == F.col("ry")
    within = named(apart, "x").join(named(inside, "y"), same & fits & (need <= 0)).select("x", "y")
    own = staged(named(outside(inside, sets), "y"), "outside-members")
    common = own.groupBy(F.col("ry").alias("region"), F.col("sy").alias("at")).agg(F.count(F.lit(1)).alias("often"))
    small = inside.groupBy(F.col("b").alias("of")).agg(F.min("na").alias("small"))
    mine = named(outside(apart, sets), "x").join(common, (F.col("rx") == F.col("region")) & (F.col("sx") == F.col("at")), "left").join(small, F.col("rx") == F.col("of"))
    least = F.expr(f"greatest(1, (3 * (nx + greatest(small, nx * {MIN_PERCENT} div 100)) + 6) div 7 - ix)")
    place = F.row_number().over(Window.partitionBy("rx", "x").orderBy(F.coalesce("often", F.lit(0)), "sx"))
    rare = mine.withColumn("place", place).filter(F.col("often").isNotNull() & (F.col("place") <= F.col("nx") - F.col("ix") - least + 1))
    shared = rare.join(own, same & (F.col("sx") == F.col("sy")) & fits & (need > 0)).select("x", "y")
    return within.unionByName(shared).filter("x <> y").distinct().select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, _text, n_shingles, _root (the component's node) and component_id (smallest id reachable by links) for every row.

    Null, empty and blank texts have no shingles and are linked with nothing, so their component is their own id. Rows
    with equal sets are linked; repeated rows and equal ids are kept. A null id is the smallest only where no other id
    is reachable. Other columns of ``docs`` are not read.
    """
    whole = staged(document_sets(docs, id_col, text_col), "document-sets")
    rows = whole.select(id_col, "_text", "n_shingles", "node")
    roots = components(links(shingle_sets(whole))).select(F.col("node").alias("_n"), "root")
    smallest = rows.filter("node is not null").groupBy("node").agg(F.min(id_col).alias("_id")).join(
        roots, F.col("node") == F.col("_n"), "left").select("node", F.coalesce("root", "node").alias("root"), "_id")
    smallest = staged(smallest, "node-ids")
    classes = smallest.groupBy(F.col("root").alias("_root")).agg(F.min("_id").alias("_least"))
    by_node = staged(smallest.join(classes, F.col("root") == F.col("_root")).select(F.col("node").alias("_n"), "root", "_least"), "components")
    return rows.join(by_node, F.col("node") == F.col("_n"), "left").select(
        id_col, "_text", "n_shingles", F.col("root").alias("_root"), F.when(F.col("node").isNull(), F.col(id_col)).otherwise(F.col("_least")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs``, with all its columns, for each component: the one with the smallest id, and among rows with
    that id the one with the smallest hash of the text. Rows without shingles all stay; repeated rows become one."""
    found = near_duplicates(docs, id_col, text_col)
    kept = found.filter("n_shingles > 0").groupBy("_root").agg(F.min(F.struct(F.col(id_col).alias("i"), F.col("_text").alias("t"))).alias("k"))
    bare = found.filter("n_shingles = 0").select(F.xxhash64(id_col, "_text").alias("_k"))
    keys = staged(kept.select(F.xxhash64("k.i", "k.t").alias("_k")).unionByName(bare).distinct(), "kept-documents")
    name = spare(docs, "_own_key")  # one column, so that the join and the removal of repeats share a shuffle
    hashed = docs.withColumn(name, F.xxhash64(F.col(id_col), F.xxhash64(text_col)))
    return hashed.join(keys, F.col(name) == F.col("_k"), "left_semi").dropDuplicates([name]).drop(name)
