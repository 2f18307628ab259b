"""Mixing, line dedup, licence scan and top-k search on odd rows and against plain versions."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm.cases import DOCS, ODD_TEXTS, documents, empty, odd_docs
from tickforge.llm import license_scan, line_dedup, queries, source_mixing, topk_search


def plain_targets(sizes):
    """Targets by resharing the excess until no source is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: source_mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(sizes.values()), set(order), {}
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            target.update({s: left * weight[s] / total for s in free})
            break
        target.update({s: 2.0 * sizes[s] for s in over})
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_mix_meets_its_targets(spark, sf):
    rows = queries.QUERIES["op7_source_mixing"](spark, sf).collect()
    source = {d.doc_id: d.source for d in documents(spark, sf).select("doc_id", "source").collect()}
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        s = source[r.doc_id]
        sizes[s] += r.size
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
    target = plain_targets(sizes)
    for r in rows:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, target[s], rel_tol=1e-9)
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6
        assert math.floor(target[s] / sizes[s] + 1e-9) <= r.copies <= math.ceil(target[s] / sizes[s] - 1e-9)


def test_mix_rerun_partitions_and_cells_agree(spark, sf, monkeypatch):
    docs = documents(spark, sf)
    one = sorted(source_mixing.copies(docs).collect())
    monkeypatch.setattr(source_mixing, "CELLS", 7)
    assert sorted(source_mixing.copies(docs.repartition(5)).collect()) == one


def test_mix_by_document_weight(spark):
    docs = documents(spark, "/root/testdata/sf0.01").withColumn("w", F.when(F.col("doc_id") % 3 == 0, 3.0).otherwise(1.0))
    rows = source_mixing.copies(docs, weight_col="w").collect()
    heavy = [r.copies for r in rows if r.doc_id % 3 == 0]
    light = [r.copies for r in rows if r.doc_id % 3]
    assert sum(heavy) / len(heavy) > 1.2 * sum(light) / len(light) and max(heavy + light) <= 2
    taken = sum(r.taken for r in rows)
    assert abs(taken - 1.5 * sum(r.size for r in rows)) < 0.03 * taken


def test_mix_odd_rows(spark):
    docs = odd_docs(spark).withColumn("_copies", F.lit("clash")).withColumn("size", F.lit(1))
    rows = source_mixing.copies(docs).collect()
    assert len(rows) == len(ODD_TEXTS) + 5 and all(r.size == 0 for r in rows if r.doc_id in (0, 1, 2, 3))
    out = source_mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)
    assert source_mixing.copies(empty(docs)).count() == 0 and source_mixing.mixed(empty(docs)).count() == 0
    assert {r.target for r in source_mixing.copies(docs.withColumn("text", F.lit(" "))).collect()} == {0.0}


def plain_lines(docs, ratio, least=2):
    """Texts without the lines on more than ``ratio`` of their source's documents."""
    blank, pages = line_dedup.BLANKS, Counter(d.source or "" for d in docs)
    lines = lambda d: {x.strip(blank) for x in (d.text or "").split("\n")} - {""}
    holds = Counter((d.source or "", k) for d in docs for k in lines(d))
    gone = {k for k, n in holds.items() if n >= least and n / pages[k[0]] > ratio}
    return gone, [None if d.text is None else "\n".join(x for x in d.text.split("\n") if (d.source or "", x.strip(blank)) not in gone) for d in docs]


@pytest.mark.parametrize("most", [0, 1000])
def test_line_dedup_odd_rows(spark, most):
    docs = odd_docs(spark).withColumn("_row", F.lit("clash")).withColumn("_drop", F.lit(1)).withColumn("_n_lines", F.lit(2)).withColumn("_salt", F.lit(3))
    out = line_dedup.drop_lines(docs, F.col("source"), counts=("h", "n", "gone"), most_hashes=most)
    assert out.columns == [*docs.columns, "h", "n", "gone"] and out.count() == docs.count()
    gone, want = plain_lines(docs.collect(), line_dedup.MAX_RATIO)
    assert gone and Counter(r.text for r in out.collect()) == Counter(want)
    assert line_dedup.drop_lines(empty(docs), F.col("source"), most_hashes=most).count() == 0


def test_line_dedup_drops_by_host_ratio(spark):
    rows = [(i, f"own {i}\n  menu \nmenu\n\nown too {i}", None, "a", 0) for i in range(6)]
    rows += [(10 + i, "menu\nrest" if i == 0 else f"x{i}", None, "b", 0) for i in range(40)]
    rows += [(100, "menu", None, None, 0), (101, None, None, "a", 0)]
    out = {r.doc_id: r for r in line_dedup.drop_lines(spark.createDataFrame(rows, DOCS), F.col("source"), counts=("h", "n", "gone")).collect()}
    assert (out[3].text, out[3].n, out[3].gone) == ("own 3\n\nown too 3", 4, 2)
    assert out[10].text == "menu\nrest" and out[100].text == "menu" and out[101].text is None and out[101].n == 0


def test_line_dedup_by_ratio_on_small_hosts(spark, tmp_path):
    rows = [(10 * n + i, f"https://h{n}.example/{i}", f"<p>menu</p><p>own {i}</p><p>{'some' if i < 2 else 'rest'}</p>") for n in (1, 2, 3, 4, 20, 30) for i in range(n)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    out = {r.page_id: r for r in queries.QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()}
    assert "menu" in out[10].text and out[10].n_dropped == 0  # a host of one page repeats nothing
    for n in (2, 3, 4):
        assert all("menu" not in out[10 * n + i].text and f"own {i}" in out[10 * n + i].text for i in range(n))
    assert all("some" not in out[k].text for k in (20, 30, 31, 40, 41)) and "rest" in out[32].text and "rest" not in out[42].text
    assert all("some" in out[k].text and "menu" not in out[k].text for k in (200, 201, 300, 301))  # 2 of 20 is not above a tenth


def test_pages_with_nulls_and_odd_urls(spark):
    rows = [(1, None, "<p>a</p>"), (2, "http://User@Host.example:80/x", None), (3, "no url", "text only"), (None, "https://h.example/?q", "<br>&lt;b&gt;&amp;lt;")]
    out = {r.page_id: r for r in line_dedup.dedup_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (out[1].host, out[1].n_lines) == ("", 1) and (out[2].host, out[2].text) == ("host.example", None)
    assert out[3].text == "text only" and out[None].text == "\n<b>&lt;"
    same = spark.createDataFrame([(7, "https://h.example/a", "<p>x</p><p>y</p>")] * 2, "page_id long, url string, html string")
    assert [(r.n_lines, r.n_dropped) for r in line_dedup.dedup_pages(same).collect()] == [(2, 2)] * 2  # repeated rows are pages
    assert line_dedup.dedup_pages(empty(same)).count() == 0


def test_license_scan_odd_rows_and_notices(spark):
    docs = odd_docs(spark).withColumn("license", F.lit("clash")).withColumn("_found", F.lit(1))
    assert {(r.license, r.n_units) for r in license_scan.scan(docs).collect()} == {(None, 0)}
    assert license_scan.scan(docs).count() == docs.count() and license_scan.scan(empty(docs)).count() == 0
    texts = {1: "x y z\nRELEASED under the   MIT-License\nmore", 2: "licensed under cc by 4.0", 3: "Licensed under CC BY-NC 4.0.",
             4: "\n".join(license_scan.NOTICES[2][1].replace(", ", ",\n").split("\n")) + "\n\nanother paragraph", 5: "the license is under review"}
    found = {r.doc_id: r.license for r in license_scan.scan(spark.createDataFrame([(k, v, None, None, 0) for k, v in texts.items()], DOCS)).collect()}
    assert found == {1: "MIT", 2: "CC-BY-4.0", 3: "CC-BY-NC-4.0", 4: "MIT", 5: None}


VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("code", T.StringType())])


def plain_search(rows, asked, k):
    bits = max(len(v) for _, v in rows if v is not None)
    code = lambda v: [bool(x is not None and x > 0) for x in v] + [False] * (bits - len(v))
    known = [(i, code(v)) for i, v in rows if i is not None and v is not None]
    out = []
    for i, q in {(i, tuple(code(v))) for i, v in asked if i is not None and v is not None}:
        best = sorted((sum(a != b for a, b in zip(q, c, strict=True)), j) for j, c in known)[:k]
        out += [(i, n + 1, j, d) for n, (d, j) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("case", ["copies", "odd", "few"])
def test_top_k_against_all_pairs(spark, case):
    rnd = random.Random(3)
    vector = lambda n=40: [rnd.uniform(-1, 1) for _ in range(n)]
    base = vector()
    if case == "copies":  # one code holds a third of the rows, another third lies close to it
        rows = [(i, base) for i in range(60)] + [(100 + i, [-x if rnd.random() < 0.1 else x for x in base]) for i in range(60)]
        rows += [(200 + i, vector()) for i in range(60)]
    elif case == "odd":
        rows = [(1, None), (None, base), (2, []), (3, [None, 1.0]), (4, vector(64)), (4, base), (4, base), (5, [float("nan")] * 3)]
        rows += [(10 + i, vector(rnd.randrange(1, 50))) for i in range(20)]
    else:
        rows = [(1, base), (2, vector()), (3, [-x for x in base])]
    df = spark.createDataFrame([(i, v, "clash") for i, v in rows], VECTORS)
    asked = [r for r in rows if r[0] is None or r[0] % 2 == 0]
    got = topk_search.search(df, spark.createDataFrame([(i, v, "clash") for i, v in asked], VECTORS), 5)
    assert sorted(tuple(r) for r in got.collect()) == plain_search(rows, asked, 5)
    assert topk_search.search(empty(df), empty(df)).count() == 0 and topk_search.search(df, empty(df)).count() == 0
