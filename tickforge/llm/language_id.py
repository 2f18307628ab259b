"""Language identification by rank-order n-gram profiles.

The profile of a language is the list of its most frequent n-grams, one to three letters of words padded with
a separator, in order of frequency over all learned documents. A document's own profile is compared with each
by the out-of-place distance: the sum of rank differences, with a fixed penalty for n-grams the language
profile lacks.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickforge.llm.common import fields, is_held_out, text_list

PROFILE = 300  # n-grams of a profile, and the penalty of one that is missing
MAX_LANGUAGES = 2_000  # bound of what the fit reads to the driver: PROFILE rows per language
UNKNOWN = "und"
SEPARATOR, BITS = 1, 21  # code points take 21 bits; no letter has code point 1


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text as numbers, ascending, and how often each occurs; none without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype("i8")
    points = np.concatenate([[SEPARATOR], np.where(_letters()[points], points, SEPARATOR), [SEPARATOR]])
    a = points[np.concatenate([[True], (points[1:] != SEPARATOR) | (points[:-1] != SEPARATOR)])]
    if len(a) < 3:
        return np.empty(0, "i8"), np.empty(0, "i8")
    pairs = a[:-1] << BITS | a[1:]
    triples = (pairs[:-1] << BITS | a[2:])[a[1:-1] != SEPARATOR]
    return np.unique(np.concatenate([a[a != SEPARATOR], pairs, triples]), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent n-grams, most frequent first, equal counts by number."""
    return codes[np.argsort(-counts, kind="stable")[:PROFILE]]


def gram_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, gram, n) over all documents with a text and a language, summed inside each task first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column(1).to_pylist(), text_list(batch.column(0)), strict=True):
                held.setdefault(lang, []).append(grams(text))
            for lang, parts in held.items():
                if len(parts) > 1:
                    codes, place = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                    sums = np.bincount(place, np.concatenate([n for _, n in parts]), len(codes)).astype("i8")
                    held[lang] = [(codes, sums)]
        for lang, [(codes, sums)] in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(sums, pa.int64())],
                                             names=["lang", "gram", "n"])
    known = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, lang_col)
    return known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclasses.dataclass(frozen=True)
class LanguageProfiles:
    """Languages in order, all n-grams of their profiles ascending, and each one's rank (PROFILE: missing)."""

    languages: tuple[str, ...]
    grams: np.ndarray
    ranks: np.ndarray


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageProfiles:
    """Profiles from all documents with a language outside the held-out fold.

    Languages whose texts hold no letter are not learned. More than ``MAX_LANGUAGES`` different values mean
    that the column holds no languages, which is an error.
    """
    counts = gram_counts(docs.filter(~is_held_out(id_col)), text_col, lang_col)
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PROFILE)
    rows = top.select("lang", "gram", "rank").limit(MAX_LANGUAGES * PROFILE + 1).collect()
    if len(rows) > MAX_LANGUAGES * PROFILE:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = tuple(sorted({r.lang for r in rows}))
    codes = np.unique(np.array([r.gram for r in rows], "i8"))
    ranks = np.full((len(codes), len(languages)), PROFILE, "i4")
    number = {x: i for i, x in enumerate(languages)}
    for r in rows:
        ranks[np.searchsorted(codes, r.gram), number[r.lang]] = r.rank - 1
    return LanguageProfiles(languages, codes, ranks)


def distances(own: np.ndarray, profiles: LanguageProfiles) -> np.ndarray:
    """Mean out-of-place distance of a document's ranked n-grams to each language, as a share of the penalty."""
    place = np.minimum(np.searchsorted(profiles.grams, own), len(profiles.grams) - 1)
    known = profiles.grams[place] == own
    theirs = np.where(known[:, None], profiles.ranks[place], PROFILE)
    apart = np.where(theirs == PROFILE, PROFILE, np.abs(theirs - np.arange(len(own))[:, None]))
    return apart.mean(axis=0) / PROFILE


def predict(docs: DataFrame, profiles: LanguageProfiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred and score for every row, from the whole text alone.

    The score is how far the runner-up is behind, as a share of its distance; with one learned language it is
    one minus the distance. Equal distances go to the first language by name. Null texts, texts without a letter,
    and all texts when no language is known give ``und`` and 0. Repeated rows and null ids give a row each.
    """
    def one(text: str) -> tuple[str, float]:
        own = ranked(*grams(text))
        if not len(own) or not profiles.languages:
            return UNKNOWN, 0.0
        far = distances(own, profiles)
        best = int(np.argmin(far))
        if len(far) == 1:
            return profiles.languages[0], float(1 - far[0])
        second = float(np.partition(far, 1)[1])
        return profiles.languages[best], (second - float(far[best])) / second if second else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [one(t) for t in text_list(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                names=[id_col, "lang_pred", "score"])
    return docs.select(id_col, text_col).mapInArrow(run, T.StructType([
        *fields(docs, id_col), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
