"""Operator 1: line removal by site-relative frequency.

For every host (site) and line: the number of the host's pages that contain
the line, divided by the host's pages.  Lines above a ratio are boilerplate
and are dropped from every page of that host.

Counting combines on the map side, so a line on a third of all pages costs a
row per task; the list of boilerplate lines is joined to (page, position,
line hash) rows without texts, a join that Spark may split when one line is
hot.  Lines are compared by a 64-bit hash within a host.

Defined results: a null or host-less url (or null source) is one site of its
own; null text stays null and has no lines; blank lines are kept and never
counted; a repeated row is a page of its own, but ``clean`` counts exact
copies within a source as one page; a line must stand on at least
``MIN_PAGES`` pages, so small sites lose nothing by chance; a page that loses
all lines stays, with empty text; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import fresh, materialize, table

MAX_RATIO = 0.1
MIN_PAGES = 3

_HIDDEN = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<!--.*?-->"
_BREAK = (r"(?i)</?(?:p|div|li|ul|ol|nav|br|hr|h[1-6]|tr|td|th|table|article|section|header|footer|aside|main|"
          r"body|html|pre|blockquote|form|title)\b[^>]*>|\x0d")
_TAG = r"<[^>]*>"


def host_of(url: Column) -> Column:
    """Lower-case host of a url; empty without one."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))),
                            r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)


def visible_text(html: Column) -> Column:
    """Text of a page with one block element per line."""
    t = F.regexp_replace(html, _HIDDEN, "")
    t = F.regexp_replace(t, _BREAK, "\n")
    t = F.regexp_replace(t, _TAG, "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def between(lines: str, gone: str) -> Column:
    """The lines at none of the positions ``gone``: the stretches between neighbouring positions, in order."""
    at = F.array_sort(gone)
    stretch = F.arrays_zip(F.concat(F.array(F.lit(-1)), at).alias("a"),
                           F.concat(at, F.array(F.size(lines))).alias("b"))
    return F.flatten(F.transform(stretch, lambda s: F.slice(lines, s["a"] + 2, s["b"] - s["a"] - 1)))


def drop_boilerplate(pages: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
                     copies: bool = True) -> DataFrame:
    """(host, text, ...) -> the same columns with cleaned ``text``, and n_lines, n_dropped long.

    All other columns pass through unchanged.  Without ``copies``, rows of one
    host with the same text count as one page, in a line's pages and the host's.
    """
    names = pages.columns
    n_lines, n_dropped = fresh(pages, "n_lines"), fresh(pages, "n_dropped")
    rest = [c for c in names if c not in ("text", "host")]
    d = pages.select(
        *[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(rest)],
        F.coalesce("host", F.lit("")).alias("host"), F.col("host").alias("host0"),
        F.split("text", "\n", -1).alias("lines"),
        F.xxhash64("text", "host").alias("rid"), F.xxhash64(F.lit(3), "text", "host").alias("rid2"))
    d = materialize(d, "lines")
    real = d.select("rid", "rid2", "host", F.posexplode("lines").alias("pos", "line")).where(
        F.length(F.trim("line")) > 0).select("rid", "rid2", "host", "pos", F.xxhash64("line").alias("h"))
    hashes = F.array_distinct(F.transform(F.filter("lines", lambda x: F.length(F.trim(x)) > 0),
                                          lambda x: F.xxhash64(x)))
    seen = d.select("host", "rid", "rid2", hashes.alias("hs"))
    if not copies:
        seen = seen.dropDuplicates(["host", "rid", "rid2"])
    counts = (seen.select("host", F.explode("hs").alias("h")).groupBy("host", "h")
              .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages))
    totals = seen.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).select(F.col("host").alias("t_host"), "pages")
    bad = (counts.join(totals, F.col("host") == F.col("t_host"))
           .where(F.col("n") > F.col("pages") * F.lit(max_ratio)).select("host", "h"))
    dropped = (real.join(bad, ["host", "h"], "left_semi").groupBy("rid", "rid2")
               .agg(F.collect_set("pos").alias("gone"))
               .select(F.col("rid").alias("d1"), F.col("rid2").alias("d2"), "gone"))
    out = d.join(dropped, (F.col("rid") == F.col("d1")) & (F.col("rid2") == F.col("d2")), "left")
    gone = F.coalesce(F.col("gone"), F.array().cast("array<int>"))
    left = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(between("lines", "gone"))
    back = {c: F.col(f"p{i}").alias(c) for i, c in enumerate(rest)}
    back |= {"host": F.col("host0").alias("host"),
             "text": F.when(F.col("lines").isNotNull(), F.concat_ws("\n", left)).alias("text")}
    blank = F.size(F.filter("lines", lambda x: F.length(F.trim(x)) > 0))
    return out.select(*[back[c] for c in names],
                      F.greatest(blank, F.lit(0)).cast("long").alias(n_lines),
                      F.size(gone).cast("long").alias(n_dropped)).withColumnsRenamed(
        {n_lines: "n_lines", n_dropped: "n_dropped"} if not {"n_lines", "n_dropped"} & {c.lower() for c in names}
        else {})


def clean(docs: DataFrame, max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Documents with the boilerplate lines of their source removed; n_chars follows the text.

    Exact copies within a source count as one page, so a document does not
    lose its own lines for being copied.
    """
    host = fresh(docs, "h")
    names = docs.columns
    d = docs.withColumn(host, F.col("source"))
    if host != "host":
        taken = fresh(d, "kept_host") if "host" in names else None
        d = d.withColumnsRenamed(({"host": taken} if taken else {}) | {host: "host"})
    out = drop_boilerplate(d, max_ratio, min_pages, copies=False).drop("host")
    if "host" in names:
        out = out.withColumnRenamed(taken, "host")
    if "n_chars" in names:
        changed = F.col("n_chars").isNotNull() & F.col("text").isNotNull()
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType))
                             .otherwise(F.col("n_chars")))
    return out.select(*[F.col(f"`{c}`") for c in names])


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        "page_id", host_of(F.col("url")).alias("host"),
        F.array_join(F.filter(F.split(visible_text(F.col("html")), "\n"), lambda x: F.length(F.trim(x)) > 0),
                     "\n").alias("text"))
    return drop_boilerplate(pages).select("page_id", "host", "n_lines", "n_dropped", "text")


QUERIES = {"op1_line_dedup": op1_line_dedup}

ORACLES = {"op1_line_dedup": r"""
WITH t AS (
  SELECT page_id, row_number() OVER () AS r,
         regexp_extract(lower(coalesce(url, '')), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1) AS host,
         regexp_replace(regexp_replace(regexp_replace(html,
           '(?is)<script\b.*?</script>|<style\b.*?</style>|<head\b.*?</head>|<!--.*?-->', '', 'g'),
           '(?i)</?(?:p|div|li|ul|ol|nav|br|hr|h[1-6]|tr|td|th|table|article|section|header|footer|aside|main|body|html|pre|blockquote|form|title)\b[^>]*>|\x0d', chr(10), 'g'),
           '<[^>]*>', '', 'g') AS x FROM pages),
l AS (
  SELECT page_id, r, host, list_filter(string_split(replace(replace(replace(replace(replace(x,
           '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), chr(10)),
           lambda y: length(trim(y, ' ')) > 0) AS lines FROM t),
e AS (SELECT r, host, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM l),
c AS (SELECT host, line, count(DISTINCT r) AS n FROM e GROUP BY 1, 2),
h AS (SELECT host, count(*) AS pages FROM l GROUP BY 1),
bad AS (SELECT c.host, line FROM c JOIN h ON c.host = h.host WHERE n >= 3 AND n > pages * 0.1::DOUBLE),
kept AS (
  SELECT r, count(*) AS n, string_agg(e.line, chr(10) ORDER BY pos) AS text
  FROM e LEFT JOIN bad ON e.host = bad.host AND e.line = bad.line WHERE bad.line IS NULL GROUP BY r)
SELECT page_id, l.host, CAST(len(lines) AS BIGINT) AS n_lines,
       CAST(len(lines) - coalesce(n, 0) AS BIGINT) AS n_dropped, coalesce(text, '') AS text
FROM l LEFT JOIN kept ON l.r = kept.r
"""}
