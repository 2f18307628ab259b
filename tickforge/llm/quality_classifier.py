"""Compression classifier for text quality.

Two zstandard dictionaries are built, one from texts labelled good and one from texts labelled bad. A text is
compressed with each, in short pieces so that the dictionary and not the text's own history decides. The
difference of the two sizes, per byte and shrunk towards the mean for short texts, is turned into a score by
a logistic curve fitted on labelled texts that neither dictionary has seen.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.llm.common import bytes_list, fields, is_held_out

DICTIONARY_BYTES = 112_640
DICTIONARY_TEXTS = 300  # per class
SAMPLE_TEXTS = 1_500  # per class, dictionary texts included: the bound of what the fit reads to the driver
SAMPLE_CHARS = 32_000  # longer texts are scored like all others, but are not learned from
PIECE = 1_024
SHRINK = 100  # bytes of evidence that the mean difference counts for
LEVEL = 3


@dataclasses.dataclass(frozen=True)
class QualityModel:
    """Dictionaries (empty: none could be built), the mean difference per byte, and the logistic curve."""

    good: bytes
    bad: bytes
    mean: float
    offset: float
    slope: float


def dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of the texts' shared content; the texts themselves where there are too few to train one."""
    try:
        return zstd.train_dictionary(DICTIONARY_BYTES, texts).as_bytes()
    except zstd.ZstdError:
        return b"\n".join(texts)[-DICTIONARY_BYTES:]


@functools.lru_cache(maxsize=4)
def _compressor(content: bytes) -> zstd.ZstdCompressor:
    held = zstd.ZstdCompressionDict(content) if len(content) >= 8 else None
    if held:
        held.precompute_compress(level=LEVEL)
    return zstd.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)


def differences(texts: list[bytes], model: QualityModel) -> np.ndarray:
    """Per byte, how much longer a text gets with the bad dictionary than with the good one."""
    good, bad = _compressor(model.good).compress, _compressor(model.bad).compress
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        pieces = [text[a:a + PIECE] for a in range(0, len(text), PIECE)]
        gain = sum(len(bad(p)) - len(good(p)) for p in pieces)
        out[i] = (gain + model.mean * SHRINK) / (len(text) + SHRINK)
    return out


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of a label on one number: Newton steps with a small ridge on the scaled slope."""
    middle, width = x.mean(), x.std() + 1e-12
    a, w = np.c_[np.ones(len(x)), (x - middle) / width], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(2), a.T @ (y - p) - 0.1 * w)
        w = w + step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0] - w[1] * middle / width), float(w[1] / width)


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(label, text) of at most ``SAMPLE_TEXTS`` documents per class, chosen by a hash of the id.

    The ids are chosen from the labels alone; they are few, so the texts are not shuffled to find them.
    """
    by_id = labels.filter(~is_held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(
        F.min(label_col).alias("_label"), F.max(label_col).alias("_other")).filter("_label = _other and _label in (0, 1)")
    order = [F.xxhash64(F.col("_id").cast("string"), F.lit("quality")), F.col("_id")]
    chosen = None
    for value in (0, 1):
        part = by_id.filter(F.col("_label") == value).orderBy(*order).limit(SAMPLE_TEXTS)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter(
        F.col("_text").isNotNull() & (F.length("_text") <= SAMPLE_CHARS))
    return texts.join(F.broadcast(chosen.select("_id", "_label")), "_id").select(
        order[0].alias("_order"), "_id", "_label", F.col("_text").cast("binary").alias("_text"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> QualityModel:
    """Learn from labelled documents outside the held-out fold.

    Ids with two different labels teach nothing. Without texts of both classes the score of every document is
    the smoothed share of good labels.
    """
    rows = sorted(labelled_sample(docs, labels, id_col, text_col, label_col).collect(), key=lambda r: (r[0], r[1], bytes(r[3])))
    texts = {v: [bytes(r[3]) for r in rows if r[2] == v] for v in (0, 1)}
    prior = float(np.log((len(texts[1]) + 1) / (len(texts[0]) + 1)))
    if not all(len(t) >= 2 for t in texts.values()):
        return QualityModel(b"", b"", 0.0, prior, 0.0)
    for_dictionary = {v: min(DICTIONARY_TEXTS, len(t) // 2) for v, t in texts.items()}
    model = QualityModel(*(dictionary(texts[v][:for_dictionary[v]]) for v in (1, 0)), 0.0, 0.0, 0.0)
    rest = {v: t[for_dictionary[v]:] for v, t in texts.items()}
    sizes = np.array([len(t) for t in rest[1]]) + SHRINK
    mean = float(np.sum(differences(rest[1], model) * sizes) / max(1, np.sum(sizes - SHRINK)))
    model = dataclasses.replace(model, mean=mean)
    x = np.concatenate([differences(rest[v], model) for v in (0, 1)])
    offset, slope = _curve(x, np.repeat([0.0, 1.0], [len(rest[0]), len(rest[1])]))
    return dataclasses.replace(model, offset=offset, slope=slope)


def _scores(texts: pa.Array, model: QualityModel) -> np.ndarray:
    z = model.offset + model.slope * differences(bytes_list(texts), model)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1, from the whole text alone) and predicted (1 from 0.5 on) for every row.

    Null and empty texts get the score of the mean difference. Repeated rows and null ids give a row each.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _scores(batch.column(1), model)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype("i4"))], names=[id_col, "score", "predicted"])
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([
        *fields(docs, id_col), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def accepted(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is predicted good. Only the text leaves the JVM."""
    @F.arrow_udf(T.BooleanType())
    def good(texts: pa.Array) -> pa.Array:
        return pa.array(_scores(texts, model) >= 0.5)
    return docs.filter(good(F.col(text_col)))
