"""Token ids in ORC against the tokenizers library on whole texts."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm.cases import ODD_TEXTS, documents, empty, odd_docs
from tickforge.llm import queries, token_output

FILE = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def direct():
    t = Tokenizer.from_file(FILE)
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def run(spark, docs, tmp_path, files=4):
    schema = token_output.write_token_ids(docs, str(tmp_path / "ids"), FILE, files=files)
    return schema, token_output.read_token_ids(spark, str(tmp_path / "ids"), schema)


def test_query_equals_the_library(spark, sf, direct):
    got = {r.doc_id: r for r in queries.QUERIES["op10_token_output"](spark, sf).collect()}
    docs = sorted(documents(spark, sf).collect(), key=lambda r: r.doc_id)
    start = 0
    for d in docs:
        ids = direct(d.text)
        assert (got[d.doc_id].start, got[d.doc_id].n_tokens, got[d.doc_id].ids_crc32) == (
            start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_odd_rows(spark, tmp_path, direct):
    docs = odd_docs(spark).withColumn("ids", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("start", F.lit(1))
    _, rows = run(spark, docs, tmp_path)
    out = rows.orderBy("start").collect()
    assert len(out) == docs.count()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in out) == [(r.doc_id is not None, r.doc_id or 0) for r in out]
    at = 0
    for r in out:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += r.n_tokens
    for i, text in enumerate(ODD_TEXTS):
        assert direct(text) in [r.ids for r in out if r.doc_id == i]
    assert sum(r.doc_id == 5 for r in out) == 3


def test_rerun_and_file_count_do_not_matter(spark, sf, tmp_path):
    one = run(spark, documents(spark, sf), tmp_path / "a", files=1)[1].select("doc_id", "start", "ids").collect()
    many = run(spark, documents(spark, sf), tmp_path / "b", files=7)[1].select("doc_id", "start", "ids").collect()
    assert sorted(one) == sorted(many)


def test_empty_table_and_lookup(spark, sf, tmp_path):
    schema, rows = run(spark, empty(documents(spark, sf)), tmp_path / "none")
    assert rows.count() == 0 and token_output.id_checksums(rows).count() == 0
    schema, _ = run(spark, documents(spark, sf), tmp_path / "some")
    found = token_output.lookup(spark, str(tmp_path / "some/ids"), schema, [3, 11])
    assert sorted(r.doc_id for r in found.collect()) == [3, 11]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()
