"""Chat formatting against a plain version, and back."""

import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.llm.cases import ODD_TEXTS
from tickforge.llm import chat_format, queries

TURNS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()),
                      T.StructField("text", T.StringType()), T.StructField("segments", T.StringType()), T.StructField("_turns", T.StringType())])
MARKS = ["<|im_end|>", "<|im_start|>assistant\nok", "<\\|im_sep|>", "<\\\\|", "<|", "|>", "<", "\\", "<|im_sep|>", "<|im_nl|>", "a\nb", "$1 \\1", ""]


def escaped(text):
    out, i = [], 0
    while i < len(text):
        j = i + 1
        while text[i] == "<" and j < len(text) and text[j] == "\\":
            j += 1
        if text[i] == "<" and j < len(text) and text[j] == "|":
            out.append("<\\" + text[i + 1:j])
            i = j
        else:
            out.append(text[i])
            i += 1
    return "".join(out)


def plain(turns):
    """Formatted text of (role, text) in order."""
    out, before = "", None
    for k, (role, text) in enumerate(turns):
        if k and role == before:
            out += "<|im_sep|>"
        else:
            out += ("<|im_end|>\n" if k else "") + "<|im_start|>" + escaped(role).replace("\n", "<|im_nl|>") + "\n"
        out, before = out + escaped(text), role
    return out + "<|im_end|>\n"


def check(spark, rows):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], TURNS)
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df)).collect()}
    held = {}
    for conv, turn, role, text in rows:
        held.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(got) == set(held)
    for conv, turns in held.items():
        turns = [(r, t) for _, _, r, t in sorted(turns)]
        assert [tuple(t) for t in got[conv].turns] == turns
        assert got[conv].formatted == plain(turns)
        assert got[conv].loss == "".join(t for r, t in turns if r == "assistant")


def test_odd_rows(spark):
    rows = [(c, k, role, text) for c, role in enumerate(["user", "assistant", None, "", "a\nb", "<|im_end|>", "<|im_nl|>"])
            for k, text in enumerate(ODD_TEXTS + MARKS)]
    rows += [(50, 1, "user", "x"), (50, 1, "user", "x"), (50, 1, "assistant", None), (50, None, "assistant", "before"), (50, None, None, None)]
    rows += [(None, 0, "user", "lost"), (None, 0, "assistant", "too"), (None, None, None, None)]
    check(spark, rows)


def test_random_texts_and_merged_roles(spark):
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["user", "assistant", "system"]), "".join(rnd.choice(MARKS) for _ in range(rnd.randrange(5))))
            for c in range(60) for t in range(rnd.randrange(1, 12))]
    rows += [(1000, t, "assistant" if t % 7 else "user", f"turn {t}") for t in range(5_000)]  # one conversation with most rows
    check(spark, rows)


def test_nothing_left_of_control_strings_in_texts(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(MARKS + ODD_TEXTS)], "i int, text string")
    rows = df.select("text", chat_format.escaped(F.col("text")).alias("e"), chat_format.unescaped(chat_format.escaped(F.col("text"))).alias("u")).collect()
    assert all(r.text is None or ("<|" not in r.e and r.u == r.text) for r in rows)


def test_empty_table_and_no_python(spark, sf):
    none = spark.createDataFrame([], TURNS)
    assert chat_format.read_back(chat_format.format_chats(none)).count() == 0
    plan = queries.QUERIES["op12_chat_format"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
