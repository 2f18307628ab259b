"""Registered queries of the text operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickforge.llm import (
    byte_bpe, chat_format, fill_in_middle, jaccard_join, language_id, license_scan, line_dedup, quality_classifier, quality_rules, source_mixing, token_output,
    tokenizer_alignment, topk_search,
)
from tickforge.llm.common import is_held_out, table
from tickforge.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def keep(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return keep


@register("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a classifier that has not seen the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, model).select("doc_id", is_held_out().alias("held_out"), "score", "predicted")


@register("op2_byte_bpe")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents encoded and decoded again, as digests."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return byte_bpe.digests(byte_bpe.decode(ids, ranks))


@register("op3_jaccard_join")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of near copies that each document belongs to."""
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@register("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language by profiles that have not seen the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


@register("op5_topk_search", topk_search.SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest codes of every vector whose id is divisible by 100, among all vectors."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.search(vectors, vectors.filter("vec_id % 100 = 0"))


@register("op6_quality_rules")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and robust outliers of every document, per language and source."""
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@register("op7_source_mixing", source_mixing.SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is taken when sources are mixed to their targets."""
    return source_mixing.copies(table(spark, sf_dir, "documents"))


@register("op8_line_dedup", line_dedup.SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's text without the lines that are boilerplate on its host."""
    return line_dedup.dedup_pages(table(spark, sf_dir, "pages"))


@register("op9_license_scan", license_scan.SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence notice that each document carries."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


@register("op10_token_output")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as token ids in ORC, read back, with their place in the sequence and a checksum."""
    path = scratch_path(spark, "token-ids")
    schema = token_output.write_token_ids(table(spark, sf_dir, "documents"), path,
                                          public_tokenizers.path("word_bpe_49k.json"))
    return token_output.id_checksums(token_output.read_token_ids(spark, path, schema))


@register("op11_tokenizer_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document aligned between two vocabularies; its groups as a digest, its links against the corpus."""
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    rows = tokenizer_alignment.align(table(spark, sf_dir, "documents"), *paths, kept=lambda groups: F.sha2(groups, 256))
    return rows.withColumnRenamed("groups", "groups_sha256")


@register("op12_chat_format", chat_format.SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations formatted and read back, as digests of their turns and of the text under the loss mask."""
    chats = chat_format.format_chats(chat_format.with_injection(table(spark, sf_dir, "conversations")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chat_format.read_back(chats).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


@register("op13_fill_in_middle", fill_in_middle.SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents rearranged for filling in their middle and put together again, as digests."""
    rows = fill_in_middle.restore(fill_in_middle.transform(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2("restored", 256).alias("restored_sha256"))
