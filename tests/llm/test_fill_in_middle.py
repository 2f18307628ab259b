"""Fill-in-middle against a plain version, and back."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import DOCS, documents, empty, odd_docs
from tickforge.llm import fill_in_middle

UNIT = re.compile("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
TRICKY = ["<<P><", "<P>", "a <S> b", "<M", "> <P", "S> <", "<<< >>>", " lead and trail  ", "é" * 50 + " ü 😀", "a", "\n", "x y z", "P>a <S", "<p> <s>"]


def plain(doc_id, text, seed=42, fim=50, spm=80):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if form == "spm" else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return len(units), form, len(prefix), len(middle), out


def rows_of(df, *more):
    return sorted((r.doc_id is not None, r.doc_id or 0, r.n, r.form, r.prefix_chars or 0, r.middle_chars or 0, r.output, *(r[m] for m in more)) for r in df.collect())


def wanted(docs, **kw):
    made = [(r.doc_id, *plain(r.doc_id, r.text, **kw), r.text or "") for r in docs.collect()]
    return sorted((i is not None, i or 0, n, f, p or 0, m or 0, o, t) for i, n, f, p, m, o, t in made)


@pytest.mark.parametrize("size", [1, 300, 2_000_000])
def test_against_the_plain_version(spark, sf, size, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "SLICE_BYTES", size)
    tricky = spark.createDataFrame([(100 * j + i, t, None, None, 0) for j in range(8) for i, t in enumerate(TRICKY)], DOCS)
    docs = odd_docs(spark).unionByName(tricky).unionByName(documents(spark, sf).limit(50))
    docs = docs.withColumn("output", F.lit("clash")).withColumn("n", F.lit(1)).withColumn("_h0", F.lit("x")).withColumn("restored", F.lit("y"))
    for kw in ({}, {"fim_percent": 100, "spm_percent": 50, "seed": 7}):
        out = fill_in_middle.restore(fill_in_middle.transform(docs, **kw))
        assert rows_of(out, "restored") == wanted(docs, seed=kw.get("seed", 42), fim=kw.get("fim_percent", 50), spm=kw.get("spm_percent", 80))
    forms = {r.form for r in fill_in_middle.transform(docs, fim_percent=100, spm_percent=50).select("form").distinct().collect()}
    assert forms == {"plain", "psm", "spm"}


def test_empty_table_and_clashing_names(spark):
    docs = empty(odd_docs(spark))
    assert fill_in_middle.restore(fill_in_middle.transform(docs)).count() == 0
    rows = fill_in_middle.transform(odd_docs(spark)).withColumn("restored", F.lit("clash"))
    assert fill_in_middle.restore(rows).columns == [*rows.columns, "restored_"]


def test_an_output_without_its_markers_is_an_error(spark):
    for output, form in (("no marker", "psm"), ("<S>a<P>b<M>c", "psm"), ("x<P>a<S>b<M>c", "psm"), ("<S>a<P>b", "spm")):
        rows = spark.createDataFrame([(1, output, form)], "doc_id long, output string, form string")
        with pytest.raises(Exception, match="marker"):
            fill_in_middle.restore(rows).collect()
