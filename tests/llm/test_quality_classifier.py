"""The compression classifier: held-out accuracy, what it may learn from, odd rows."""

import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import SF, documents, empty, odd_docs
from tickforge.llm import quality_classifier as qc
from tickforge.llm import queries


@pytest.fixture(scope="module")
def bigger(spark):
    return documents(spark, "/root/testdata/sf0.1"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_held_out_accuracy(spark, bigger):
    docs, labels = bigger
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = [r for r in queries.QUERIES["op1_quality_classifier"](spark, "/root/testdata/sf0.1").collect()]
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good = [p for p, t in held if t == 1]
    bad = [p for p, t in held if t == 0]
    assert sum(good) / len(good) > 0.98 and sum(bad) / len(bad) < 0.08


def test_held_out_labels_and_other_columns_change_nothing(spark):
    docs, labels = documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(qc.is_held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).withColumn("score", F.lit(1))
    a, b = qc.fit(docs, labels), qc.fit(other, flipped)
    assert a == b
    assert sorted(qc.score(docs, a).collect()) == sorted(qc.score(other, b).collect())


def test_odd_rows_and_columns(spark):
    docs, labels = odd_docs(spark).withColumn("score", F.lit("clash")), spark.read.parquet(f"{SF}/labels.parquet")
    model = qc.fit(documents(spark), labels)
    rows = qc.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by_text = {}
    for d, r in zip(docs.collect(), rows, strict=True):
        assert by_text.setdefault(d.text or "", r.score) == r.score
    kept = qc.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in rows)


def test_without_labels_or_rows(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    none = qc.fit(docs, empty(labels))
    assert {r.score for r in qc.score(docs, none).collect()} == {0.5}
    only_good = qc.fit(docs, labels.filter("quality = 1"))
    assert {r.predicted for r in qc.score(docs, only_good).collect()} == {1}
    assert qc.score(empty(docs), qc.fit(docs, labels)).count() == 0
    twice = labels.unionByName(labels.withColumn("quality", 1 - F.col("quality")))
    assert qc.fit(docs, twice).good == b""
    assert qc.fit(docs, labels.unionByName(labels)) == qc.fit(docs, labels)
