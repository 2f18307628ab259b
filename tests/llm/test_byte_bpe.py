"""Byte-level BPE against the tiktoken library on whole texts."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tests.llm.cases import ODD_TEXTS, documents, empty, odd_docs
from tickforge.llm import byte_bpe, queries

FILE, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def direct():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.ranks(FILE), special_tokens={}).encode_ordinary


def test_query_equals_the_library(spark, sf, direct):
    got = {r.doc_id: r for r in queries.QUERIES["op2_byte_bpe"](spark, sf).collect()}
    docs = documents(spark, sf).collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = direct(d.text or "")
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()


@pytest.mark.parametrize("block_chars", [1, 50, 1_000_000])
def test_odd_rows(spark, direct, block_chars):
    docs = odd_docs(spark).withColumn("ids", F.lit("clash")).withColumn("block", F.lit(1)).withColumn("words", F.lit(1))
    rows = byte_bpe.decode(byte_bpe.encode(docs, FILE, PATTERN, block_chars=block_chars), FILE).collect()
    want = sorted((r.doc_id is not None, r.doc_id or 0, direct(r.text or ""), (r.text or "").encode()) for r in docs.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids, bytes(r.decoded)) for r in rows) == want
    assert len(rows) > len(ODD_TEXTS)


def test_empty_table(spark, sf):
    assert byte_bpe.decode(byte_bpe.encode(empty(documents(spark, sf)), FILE, PATTERN), FILE).count() == 0


def test_the_texts_are_not_shuffled(spark, sf):
    text = queries.QUERIES["op2_byte_bpe"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 2 and "hashpartitioning(bucket" in text


def test_pattern_splits_every_code_point_as_the_library_does(direct):
    import regex

    find = regex.compile(PATTERN).findall
    differing = []
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 64):
        text = "".join(f"a{chr(c)}b1{chr(c)} {chr(c)}{chr(c)}," for c in points[at:at + 64])
        if direct(text) != [i for w in find(text) for i in direct(w)]:
            differing.append(hex(points[at]))
    assert not differing
