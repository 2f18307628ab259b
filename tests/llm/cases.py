"""Rows that every text operator must survive, and small builders."""

import os

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
SF = os.environ.get("TICKFORGE_SF_DIR", "/root/testdata/sf0.001")

ODD_TEXTS = [
    None, "", " ", "\n\n", "word", "the the the the the the", "a\x1cb\x1dc d e\u0085f", "Ünïcode é é ﬁ İstanbul ΑΣ ς",
    "emoji 😀👩‍👩‍👧 mixed 漢字かな 한국어 ไทย", "<|endoftext|> a<|startoftext|>b", "tabs\tand\r\nnew\x0blines\x0c", "it's they'll WE'VE",
    "12345 ½ ٣ ²", "null\x00byte", "long " * 30_000, "x" * 20_000, "...!!!???", "﻿bom", "a  b   c    d", "line one\nline one\nline two\nline one",
]


def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and repeated ids, an extra column."""
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"s{i % 3}", None if t is None else len(t))
            for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[5], (7, "another text under the id seven", "de", "s1", 31), (None, "no id here", "en", "s1", 10),
             (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def empty(df):
    return df.filter("false")
