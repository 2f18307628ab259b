"""Base rules against a plain re-computation, the robust estimate against numpy on whole groups, odd rows."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tests.llm.cases import ODD_TEXTS, documents, empty, odd_docs
from tickforge.llm import quality_rules as qr
from tickforge.llm import queries
from tickforge.llm.words import WordHashes


def plain_counts(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if runs[tuple(words[i:i + 8])] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def as_counts(r):
    return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words


def plain_distances(x):
    """The same estimate with numpy: whole group in memory, no cells."""
    p, floors = x.shape[1], np.array(list(qr.STATISTICS.values()))
    centre = np.median(x, axis=0)
    cov = np.diag(np.maximum(np.median(np.abs(x - centre), axis=0) * 1.4826, floors) ** 2)
    h = math.ceil(qr.KEPT_SHARE * len(x))
    for _ in range(qr.STEPS):
        d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
        near = x[np.argsort(d, kind="stable")[:h]]
        centre, cov = near.mean(axis=0), np.cov(near.T, bias=True) + np.diag(floors ** 2)
    d = np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(cov), x - centre)
    return d * min(1, qr.chi_square(0.5, p) / np.median(d))


def test_query_against_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    docs = {d.doc_id: d for d in documents(spark, sf).collect()}
    rows = queries.QUERIES["op6_quality_rules"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert as_counts(r) == plain_counts(docs[r.doc_id].text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept) and r.kept is not None
    # every (language, source) is small here, so languages are the groups, and the small ones share the rest
    usable = [r for r in rows if not r.base_failed]
    size = Counter(docs[r.doc_id].lang for r in usable)
    own = Counter((docs[r.doc_id].lang, docs[r.doc_id].source) for r in usable)
    assert max(own.values()) < qr.MIN_GROUP
    group = {r.doc_id: (docs[r.doc_id].lang if size[docs[r.doc_id].lang] >= qr.MIN_GROUP else "") for r in usable}
    agree = 0
    for g in set(group.values()):
        ids = [i for i in group if group[i] == g]
        _, stats = qr.text_statistics([docs[i].text for i in ids], WordHashes())
        far = dict(zip(ids, plain_distances(stats), strict=True))
        agree += sum(abs(np.log(max(r.distance, 1e-3) / max(far[r.doc_id], 1e-3))) < 0.3 for r in usable if r.doc_id in far)
        for r in usable:
            if r.doc_id in far and not 0.7 < far[r.doc_id] / qr.chi_square(qr.CONFIDENCE, stats.shape[1]) < 1.4:
                assert r.kept == (far[r.doc_id] <= qr.chi_square(qr.CONFIDENCE, stats.shape[1]))
    assert agree > 0.95 * len(usable)


def test_bad_documents_go_and_good_ones_stay(spark):
    sf = "/root/testdata/sf0.1"
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in queries.QUERIES["op6_quality_rules"](spark, sf).collect() if r.doc_id in label and not r.base_failed]
    good = [r.kept for r in rows if label[r.doc_id] == 1]
    bad = [r.kept for r in rows if label[r.doc_id] == 0]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.1


def test_chi_square_quantiles():
    for p, q, value in ((2, 0.5, 1.386), (7, 0.5, 6.346), (7, 0.999, 24.32), (3, 0.99, 11.345)):
        assert abs(qr.chi_square(q, p) - value) < 0.02 * value


def test_odd_rows_and_empty_table(spark):
    docs = odd_docs(spark).withColumn("kept", F.lit("clash")).withColumn("group", F.lit(1)).withColumn("stats", F.lit(1))
    rows = qr.judge(docs).collect()
    assert len(rows) == len(ODD_TEXTS) + 5
    want = sorted((d.doc_id is not None, d.doc_id or 0, *plain_counts(d.text)) for d in docs.collect())
    assert sorted((r.doc_id is not None, r.doc_id or 0, *as_counts(r)) for r in rows) == want
    assert all(r.kept is False for r in rows if r.base_failed)
    assert qr.judge(empty(docs)).count() == 0
    copies = documents(spark).filter("doc_id = 1").crossJoin(spark.range(300))
    assert {r.kept for r in qr.judge(copies).collect()} == {True}
