"""A corpus pipeline over ``documents``: quality, boilerplate lines, near duplicates, source weights, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``. Models are fitted on the whole tables in
``sf_dir``, outside the held-out fold; each stage decides on every row that its predecessor kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm import byte_bpe, jaccard_join, line_dedup, quality_classifier, source_mixing
from tickforge.llm.common import staged, table

#: A repeated line on more than this share of the documents of its source is boilerplate.
#: Shared lines of `documents` stand on up to a tenth of a source's documents and most on more than a hundredth; a line
#: that is there in a few copies of a text only stays below, the more so the larger the source.
LINE_RATIO = 0.01
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier accepts. Null and empty texts have the mean document's score and go or stay
    by it; repeated rows are decided alike and all stay or go."""
    model = quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.accepted(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that are boilerplate in their source; ``n_chars`` follows the text.

    A document that consists of such lines alone stays, with an empty text. Null texts stay null, with a null ``n_chars``;
    rows without a source are one source; repeated rows are documents of their own.
    """
    out = line_dedup.drop_lines(docs, F.col("source"), "text", LINE_RATIO)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id. Null, empty and blank texts are copies of
    nothing and stay, but equal rows become one."""
    return jaccard_join.one_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask for. Rows without a source are one source; texts without
    words have no size and are taken by the same draw."""
    return source_mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text and the sha256 of the bytes that they decode to, one row per row; none for null and empty texts."""
    decoded = byte_bpe.decode(byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    return decoded.select("doc_id", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality classifier", quality), ("line dedup", lines), ("n-gram Jaccard join", near_duplicates),
          ("mixing sources to target weights", mix), ("byte-level BPE", tokens)]

#: SQL can express neither the classifier nor the tokenizer; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder before the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
