"""Rank-order language profiles: held-out accuracy, a plain re-computation, odd rows."""

import zlib
from collections import Counter

from pyspark.sql import functions as F

from tests.llm.cases import ODD_TEXTS, documents, empty, odd_docs
from tickforge.llm import language_id as li
from tickforge.llm import queries


def plain_profile(texts):
    """Counts of one- to three-letter n-grams of padded words, by slicing strings."""
    c = Counter()
    for t in texts:
        for w in "".join(x if x.isalpha() else " " for x in t.lower()).split():
            p = f"\x01{w}\x01"
            c.update(w)
            c.update(p[i:i + 2] for i in range(len(p) - 1))
            c.update(p[i:i + 3] for i in range(len(p) - 2))
    return c


def code(g):
    n = 0
    for ch in g:
        n = n << 21 | ord(ch)
    return n


def top(c):
    return [g for _, _, g in sorted((-n, code(g), g) for g, n in c.items())[:li.PROFILE]]


def test_query_against_plain_profiles(spark, sf):
    docs = documents(spark, sf).collect()
    learn = [d for d in docs if zlib.crc32(str(d.doc_id).encode()) % 3 != 1]
    profiles = {x: {g: i for i, g in enumerate(top(plain_profile(d.text for d in learn if d.lang == x)))}
                for x in sorted({d.lang for d in learn})}
    got = {r.doc_id: r for r in queries.QUERIES["op4_language_id"](spark, sf).collect()}
    assert len(got) == len(docs)
    for d in docs:
        own = top(plain_profile([d.text]))
        far = {x: sum(abs(p[g] - i) if g in p else li.PROFILE for i, g in enumerate(own)) for x, p in profiles.items()}
        r = got[d.doc_id]
        assert r.lang_pred == min(far, key=lambda x: (far[x], x)) and 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 3 == 1)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {d.doc_id: d.lang for d in documents(spark, sf).collect()}
    held = [r for r in queries.QUERIES["op4_language_id"](spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumn("score", F.lit("clash")).withColumn("gram", F.lit(1))
    rows = li.predict(docs, li.fit(documents(spark))).collect()
    assert len(rows) == docs.count()
    for d, r in zip(docs.collect(), rows, strict=True):
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in d.text or "")) and 0 <= r.score <= 1
    learned = li.fit(docs)
    assert set(learned.languages) <= {"en", "de"}
    assert li.predict(docs, learned).count() == len(ODD_TEXTS) + 5


def test_nothing_learned_and_empty_table(spark, sf):
    docs = documents(spark, sf)
    none = li.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert {(r.lang_pred, r.score) for r in li.predict(docs, none).collect()} == {("und", 0.0)}
    assert li.predict(empty(docs), li.fit(empty(docs))).count() == 0
    one = li.fit(docs.withColumn("lang", F.lit("en")))
    assert {r.lang_pred for r in li.predict(docs, one).collect()} == {"en"}
