"""The exact Jaccard join against all pairs, on given documents and on cases that stress regions and recursion."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import DOCS, ODD_TEXTS, documents, empty, odd_docs
from tickforge.llm import jaccard_join as jj
from tickforge.llm import queries


def plain_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def plain_components(texts):
    """Root index per text by comparing all pairs that share a shingle."""
    sets, holders, root = [plain_set(t) for t in texts], {}, list(range(len(texts)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = {}
    for i, s in enumerate(sets):
        if s:
            root[find(i)] = find(first.setdefault(s, i))
    for i in first.values():
        for x in sets[i]:
            holders.setdefault(x, []).append(i)
    for i in first.values():
        for j in {j for x in sets[i] for j in holders[x] if j > i}:
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return sets, [find(i) for i in range(len(texts))]


def check(rows, docs):
    """rows: (doc_id, n_shingles, component_id); docs: (doc_id, text) with different ids."""
    ids, texts = [d[0] for d in docs], [d[1] for d in docs]
    sets, roots = plain_components(texts)
    least = {}
    for i, r in zip(ids, roots, strict=True):
        least[r] = min(least.get(r, i), i)
    want = sorted((i, len(s), least[r]) for i, s, r in zip(ids, sets, roots, strict=True))
    assert sorted(tuple(r) for r in rows) == want
    return want


def run(spark, docs):
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS).repartition(4)
    return jj.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect()


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_against_all_pairs(spark, sf):
    rows = queries.QUERIES["op3_jaccard_join"](spark, sf).collect()
    want = check(rows, [(d.doc_id, d.text) for d in documents(spark, sf).collect()])
    assert any(i != c for i, _, c in want)


def hard_documents(seed, vocabulary=4000):
    """Near copies at every distance around the threshold, chains of edits, passages in many documents of all lengths."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(vocabulary)}"
    passage = [word() for _ in range(30)]
    out = []
    for _ in range(6):
        base = [word() for _ in range(rnd.choice([6, 12, 40, 120]))]
        for _ in range(25):
            copy = list(base)
            for _ in range(rnd.randrange(0, max(2, len(base) // 14))):
                copy[rnd.randrange(len(copy))] = word()
            out.append(copy)
        chain = list(base)
        for _ in range(12):
            chain = list(chain)
            chain[rnd.randrange(len(chain))] = word()
            out.append(chain)
    for _ in range(120):
        own = [word() for _ in range(rnd.randrange(0, 16))]
        out.append(own + passage + [word() for _ in range(rnd.randrange(0, 8))])
    for _ in range(60):
        out.append([word() for _ in range(rnd.randrange(1, 60))])
    out += [passage[:k] for k in range(1, 31)]
    rnd.shuffle(out)
    return [(i, " ".join(x)) for i, x in enumerate(out)]


@pytest.mark.parametrize("regions", [1, 3, 32])
def test_hard_documents(spark, monkeypatch, regions):
    monkeypatch.setattr(jj, "REGIONS", regions)
    docs = hard_documents(regions)
    check(run(spark, docs), docs)


def test_without_pivots_the_counts_alone_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(jj, "LEAST_ANCHORS", jj.ANCHORS + 1)
    docs = hard_documents(11)
    check(run(spark, docs), docs)


def test_odd_rows(spark):
    docs = odd_docs(spark).withColumn("node", F.lit("clash")).withColumn("blob", F.lit(1)).withColumn("label", F.lit(1))
    rows = jj.near_duplicates(docs).collect()
    assert len(rows) == len(ODD_TEXTS) + 5
    for r in rows:
        assert (r.n_shingles == 0) <= (r.component_id == r.doc_id)
    held = {d.doc_id: d.text for d in docs.collect()}
    assert all(r.n_shingles == len(plain_set(held[r.doc_id])) for r in rows if r.doc_id not in (7, None))
    kept = jj.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sum(r.doc_id == 5 for r in kept.collect()) == 1 and sum(r.doc_id == 7 for r in kept.collect()) == 2
    assert jj.near_duplicates(empty(docs)).count() == 0 and jj.one_of_each(empty(docs)).count() == 0


def test_one_of_each_keeps_the_smallest_id(spark, sf):
    docs = documents(spark, sf)
    found = jj.near_duplicates(docs).collect()
    kept = sorted(r.doc_id for r in jj.one_of_each(docs).collect())
    assert kept == sorted(r.doc_id for r in found if r.n_shingles == 0 or r.component_id == r.doc_id)


def test_many_copies_cost_one_comparison_each(spark):
    rnd = random.Random(5)
    base = [f"v{rnd.randrange(9999)}" for _ in range(80)]
    docs = []
    for i in range(1500):
        copy = list(base)
        copy[rnd.randrange(80)] = f"x{i}"
        docs.append((i, " ".join(copy)))
    rows = run(spark, docs)
    assert {r.component_id for r in rows} == {0}


def test_families_without_their_middle(spark, monkeypatch):
    """Near copies of two texts that are not in the table themselves, some linked to each other and some to nobody."""
    monkeypatch.setattr(jj, "REGIONS", 8)
    rnd, docs = random.Random(2), []
    for _ in range(2):
        base = [f"v{rnd.randrange(9999)}" for _ in range(140)]
        for _ in range(120):
            copy = list(base)
            for _ in range(rnd.randrange(1, 5)):
                copy[rnd.randrange(140)] = f"x{rnd.randrange(10 ** 6)}"
            docs.append(" ".join(copy))
    rnd.shuffle(docs)
    docs = list(enumerate(docs))
    want = check(run(spark, docs), docs)
    assert 2 < len({component for _, _, component in want}) < 120


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    found = {r.node: r.root for r in jj.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[100 + i] for i in range(30)} == {100}


def test_texts_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text
    docs = hard_documents(5)[:60]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], DOCS)
    check(jj.near_duplicates(df.withColumn("text", seen.asNondeterministic()("text"))).select("doc_id", "n_shingles", "component_id").collect(), docs)
    assert read.value == len(docs)


def test_counts_do_not_make_a_row_per_node_and_task(spark, monkeypatch):
    """400 nodes with 40 common shingles each, counted by 40 tasks."""
    made, nodes, tasks = [], 400, 40
    rows = spark.range(nodes).selectExpr("id as node", "explode(sequence(1L, 40L)) as shingle").selectExpr(
        "shingle", "0 as role", "cast(null as long) as label", "node", "81L as info")
    real = type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, *a, **k: made.append(real(self, *a, **k)) or made[-1])
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", tasks)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = {r.node: (r.label, r.c) for r in jj._shared(rows).collect()}
        assert found == {n: (None, 40) for n in range(nodes)}
        assert made[0].count() <= tasks * jj.LEAST_PACKS
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
