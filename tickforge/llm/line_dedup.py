"""Line deduplication by site-relative frequency.

For every host, the share of its pages that contain a line is the line's boilerplate ratio; lines above a
ratio go. Lines are counted by a 64-bit hash per (host, line) with map-side combining, so neither a large host nor
a frequent line meets in one task. The lines that go are few per host by construction: their ratios add up to at
most the mean number of different lines on a page, so there are at most that many over the ratio. They are written as
one array per host. Up to ``MOST_HASHES`` of them are broadcast and pages are rewritten where they are; beyond that, pages
meet them by host and salt, so that a host's pages are spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickforge.llm.common import staged

MAX_RATIO = 0.1
MIN_PAGES = 2  # the ratio alone decides, but a line on a single page repeats nothing
MOST_HASHES = 2_000_000  # of all hosts, and as many hosts, that are broadcast: 16 MB and the host names
SALTS = 32
BLANKS = " \t\n\r\x0b\x0c"
FILLED = "(?m)^[ \\t\\r\\x0B\\f]*[^ \\t\\n\\r\\x0B\\f][^\\n]*$"  # a line that is not blank

HTML_DROPPED = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
HTML_BREAKS = (r"(?i)</?(p|div|br|li|ul|ol|nav|h[1-6]|article|aside|footer|header|head|title|section|main|form|tr|td|th|table|"
               r"blockquote|pre|body|html)\b[^>]*>")
HTML_TAGS = r"<[^>]*>"
#: Entities, in the order in which they are replaced.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&middot;": "·", "&copy;": "©", "&amp;": "&"}
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: str | Column) -> Column:
    """The lower-case host name; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def text_of_html(html: str | Column) -> Column:
    """Text with a line per block element."""
    c = F.regexp_replace(html, HTML_DROPPED, "")
    c = F.regexp_replace(F.regexp_replace(c, HTML_BREAKS, "\n"), HTML_TAGS, "")
    for entity, char in ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def _keys(text: Column) -> Column:
    """Hash of each line that is not blank, without surrounding white space."""
    lines = F.filter(F.transform(F.split(text, "\n", -1), _trimmed), lambda x: x != "")
    return F.transform(lines, lambda x: F.xxhash64(x))


def boilerplate(docs: DataFrame, host: Column, text: Column, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(_host, _drop): for each host with boilerplate, the hashes of its lines above the ratio."""
    pages = docs.select(host.alias("_host"), F.array_distinct(_keys(text)).alias("_keys"))
    totals = docs.select(host.alias("_host")).groupBy("_host").agg(F.count(F.lit(1)).alias("_pages"))
    # the outer form, because a filter on the array's size would compute the array once more
    lines = pages.select("_host", F.explode_outer("_keys").alias("_line")).filter("_line is not null")
    counts = lines.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n"))
    often = counts.filter(F.col("_n") >= min_pages).join(totals, "_host").filter(F.col("_n") / F.col("_pages") > max_ratio)
    return often.groupBy("_host").agg(F.sort_array(F.collect_list("_line")).alias("_drop"))


def drop_lines(docs: DataFrame, host: Column, text_col: str = "text", max_ratio: float = MAX_RATIO,
               min_pages: int = MIN_PAGES, text: Column | None = None, counts: tuple[str, str, str] | None = None,
               most_hashes: int = MOST_HASHES) -> DataFrame:
    """``docs`` with ``text_col`` rewritten; ``counts`` names further columns for the host and the numbers of lines that
    are not blank and of those dropped.

    Every row stays. Null hosts are one host with the empty one. Null texts stay null, with no lines; blank lines
    always stay. A line counts once per page however often it stands there, and a repeated row is a page of its
    own. Comparison ignores white space around a line and nothing else. Two lines of a host whose 64-bit hashes
    agree would be taken for one.
    """
    host, text = F.coalesce(host, F.lit("")), F.col(text_col) if text is None else text
    drop = staged(boilerplate(docs, host, text, max_ratio, min_pages), "boilerplate")
    own = docs.select(F.struct(*docs.columns).alias("_row"), host.alias("_own_host"), text.alias("_own_text"))
    size = drop.agg(F.coalesce(F.sum(F.size("_drop") + F.length("_host") / 8 + 1), F.lit(0))).head()[0]
    same_host = F.col("_own_host") == F.col("_host")
    if size <= most_hashes:
        joined = own.join(F.broadcast(drop), same_host, "left")
    else:
        salted = drop.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn("_own_salt", F.pmod(F.xxhash64("_own_text"), F.lit(SALTS)).cast("int")).join(
            salted, same_host & (F.col("_own_salt") == F.col("_salt")), "left")
    mine, gone = F.col("_own_text"), F.coalesce(F.col("_drop"), F.array().cast("array<bigint>"))
    kept = F.filter(F.split(mine, "\n", -1), lambda x: (_trimmed(x) == "") | ~F.array_contains(gone, F.xxhash64(_trimmed(x))))
    rewritten = F.when(F.col("_drop").isNull(), mine).otherwise(F.array_join(kept, "\n"))
    done = joined.select("_row", F.col("_own_host").alias("_counts0"), rewritten.alias("_rewritten"), "_own_text")
    if counts:
        filled = lambda c: F.coalesce(F.regexp_count(c, F.lit(FILLED)), F.lit(0)).cast("long")
        done = done.withColumn("_counts1", filled(F.col("_own_text"))).withColumn("_counts2", F.col("_counts1") - filled(F.col("_rewritten")))
    columns = [(F.col("_rewritten") if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns]
    return done.select(*columns, *(F.col(f"_counts{i}").alias(c) for i, c in enumerate(counts or ())))


def dedup_pages(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, host, n_lines, n_dropped and the remaining text of every page."""
    known = pages.select("page_id", "url", F.col("html").alias("text"))
    out = drop_lines(known, host_of("url"), "text", max_ratio, min_pages, text_of_html("text"), ("host", "n_lines", "n_dropped"))
    return out.select("page_id", "host", "n_lines", "n_dropped", "text")


def _sql_text() -> str:
    c = f"regexp_replace(regexp_replace(regexp_replace(html, '{HTML_DROPPED}', '', 'g'), '{HTML_BREAKS}', chr(10), 'g'), '{HTML_TAGS}', '', 'g')"
    for entity, char in ENTITIES.items():
        c = f"replace({c}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return c


_BLANKS_SQL = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def sql(max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> str:
    """``dedup_pages`` for DuckDB."""
    return rf"""
WITH p AS (SELECT row_number() OVER () AS k, page_id, lower(coalesce(regexp_extract(url, '{HOST}', 1), '')) AS host, {_sql_text()} AS text FROM pages),
  s AS (SELECT k, page_id, host, text, string_split(text, chr(10)) AS lines FROM p),
  e AS (SELECT k, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM s),
  n AS (SELECT k, host, line, i, trim(line, {_BLANKS_SQL}) AS t FROM e),
  t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
  b AS (SELECT n.host, n.t FROM n JOIN t ON n.host = t.host WHERE n.t <> '' GROUP BY n.host, n.t, t.pages
        HAVING count(DISTINCT k) >= {min_pages} AND count(DISTINCT k)::DOUBLE / t.pages > {max_ratio}),
  f AS (SELECT n.k, n.line, n.i, n.t <> '' AS counted, b.t IS NOT NULL AS gone FROM n LEFT JOIN b ON n.host = b.host AND n.t = b.t),
  g AS (SELECT k, sum(counted::INT)::BIGINT AS n_lines, sum((counted AND gone)::INT)::BIGINT AS n_dropped,
          coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM f GROUP BY k)
SELECT p.page_id, p.host, coalesce(g.n_lines, 0) AS n_lines, coalesce(g.n_dropped, 0) AS n_dropped,
  CASE WHEN p.text IS NOT NULL THEN coalesce(g.text, '') END AS text
FROM p LEFT JOIN g ON p.k = g.k
"""


SQL = sql()
