"""Tokenizer alignment against both libraries on whole texts, aligned by byte sets."""

import hashlib
import random
from bisect import bisect_right
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tests.llm.cases import DOCS, ODD_TEXTS, documents, empty, odd_docs
from tickforge.llm import queries
from tickforge.llm import tokenizer_alignment as ta
from tickforge.llm.token_output import byte_characters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TRICKY = ["a\n b", "a \nb", "a\n\n  b  ", " lead", "  two", "trail ", "trail  ", "tab\tx", "tab \t x\t", "a▁b", "▁", "word \n", "\n", "\t", " ", "it's 'll x'",
          "<s> </s> <unk> <0x0A>", "<|endoftext|>", "a\rb", "x\r\ny", ");\r\n", "nb sp", "    em", "ﬁ Ĳ ①", "12 345", "é é", "﻿x", "a\x00b", "漢字 かな", "😀 😀😀"]


@pytest.fixture(scope="module")
def library():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: bytes([x]) for x, c in byte_characters().items()}

    def tokens(text):
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        raw_a = [b"".join(back[c] for c in a.id_to_token(i)) for i in ids_a]
        pieces = [b.id_to_piece(i) for i in ids_b]
        raw_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(ids_b, pieces, strict=True)]
        return (ids_a, raw_a), (ids_b, raw_b)
    return tokens


def plain(rows, tokens):
    """(id, text) to measures and groups, by comparing byte ranges."""
    per_text, count = {}, Counter()
    for _, text in rows:
        if text and text not in per_text:
            (ids_a, raw_a), (ids_b, raw_b) = tokens(text)
            per_text[text] = None
            if b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
                spans = []
                for ids, raw in ((ids_a, raw_a), (ids_b, raw_b)):
                    at, out = 0, []
                    for i, x in zip(ids, raw, strict=True):
                        out.append((i, at, at + len(x)))
                        at += len(x)
                    spans.append(out)
                owner = [i for i, (_, s, e) in enumerate(spans[1]) for _ in range(s, e)]
                links = [(i, spans[1][j][0]) for i, s, e in spans[0] for j in sorted(set(owner[s:e]))]
                common = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
                groups, low = [], [0, 0]
                for end in common:
                    high = [bisect_right(side, end, key=lambda x: x[2]) for side in spans]
                    groups.append("|".join(",".join(str(x[0]) for x in side[a:b]) for side, a, b in zip(spans, low, high, strict=True)))
                    low = high
                per_text[text] = (len(ids_a), len(ids_b), groups, links)
        if text and per_text[text]:
            count.update(set(per_text[text][3]))
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    out = []
    for i, text in rows:
        x = per_text.get(text) if text else None
        out.append((i, 0, 0, 0, 0, 0, 0, "") if x is None else
                   (i, x[0], x[1], len(x[2]), len(x[3]), sum(count[p] == best[p[0]] for p in x[3]), sum(count[p] for p in x[3]), ";".join(x[2])))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("block_chars", [3_000, 6_000_000])
def test_odd_rows(spark, library, block_chars):
    rnd = random.Random(2)
    mixes = ["".join(rnd.choice(TRICKY + ["word", " and", "\n", " "]) for _ in range(6)) for _ in range(60)]
    rows = [(100 + i, t, None, None, 0) for i, t in enumerate(TRICKY + mixes + mixes[:20] + ["word and"] * 30)]
    docs = odd_docs(spark).unionByName(spark.createDataFrame(rows, DOCS))
    docs = docs.withColumn("key", F.lit("clash")).withColumn("block", F.lit(1)).withColumn("n_a", F.lit("x")).withColumn("copies", F.lit(2))
    got = ta.align(docs, A, B, block_chars=block_chars).collect()
    assert ordered(tuple(r) for r in got) == ordered(plain([(r.doc_id, r.text) for r in docs.collect()], library))
    assert len(got) > len(ODD_TEXTS)


def test_query_equals_the_libraries(spark, sf, library):
    got = [tuple(r) for r in queries.QUERIES["op11_tokenizer_alignment"](spark, sf).collect()]
    want = plain([(d.doc_id, d.text) for d in documents(spark, sf).collect()], library)
    assert ordered(got) == ordered((*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in want)


def test_the_short_way_is_taken():
    tokens = ta.pair(A, B)
    assert tokens.cuts and tokens.stretches("a b\nc ") == [" a", " b", "\nc", " "] and tokens.stretches("a b c") == [" a b c"]


def test_empty_table(spark):
    assert ta.align(empty(odd_docs(spark)), A, B).count() == 0
    assert ta.align(odd_docs(spark).withColumn("text", F.lit("")), A, B).select("n_links", "groups").distinct().collect() == [(0, "")]
