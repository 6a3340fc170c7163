"""Site-relative line dedup: lines that stand on too large a share of a host's pages are boilerplate.

Each page's distinct lines are hashed and (host, line) is counted with map-side combining, so
neither a host with a third of the pages nor a line on each of them is gathered in one place. The
lines over the ratio are few for each host, since each of them needs `ratio` of its pages; they
become one array for each host. The hosts that have any are broadcast if these arrays hold fewer
lines than a limit; otherwise they are copied over `salts` and joined by (host, salt), so that a hot
host is dealt over many tasks.

Defined results: a null or empty text has no lines; blank lines are neither counted nor dropped; a
line that repeats within a page counts once and goes from all its places; a null host is a host of
its own (op3 takes the host of the URL in lower case, without user and port); hosts with fewer than `min_pages` pages and lines on fewer than `min_copies` pages lose
nothing; repeated rows are separate pages; an empty table gives an empty result; other columns are
carried in the struct `row`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .util import cut, read

RATIO, MIN_PAGES, MIN_COPIES = 0.1, 5, 3
SMALL_LINES, SALTS = 200_000, 32

#: Lines of a web page: scripts and styles go, tags end lines, outer spaces go.
SCRIPT_RE, TAG_RE = r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", r"<[^>]*>"
HOST_RE = r"^[a-zA-Z]+://(?:[^/?#@]*@)?([^/:?#@]+)"


def boilerplate(pages: DataFrame, host: Column, lines: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, min_copies: int = MIN_COPIES, once: bool = False) -> DataFrame:
    """Rows (host, line, n, pages): hash of each line on more than `ratio` of a host's pages; once: exact copies on a host are one page."""
    each = pages.select(host.alias("host"), F.array_distinct(F.transform(F.filter(lines, lambda x: x != ""), lambda x: F.xxhash64(x))).alias("lines"), F.xxhash64(lines).alias("whole"))
    if once:
        each = each.groupBy("host", "whole").agg(F.first("lines").alias("lines"))
    total = each.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    counted = each.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_copies)
    both = counted.withColumnRenamed("host", "h").join(total, F.col("h").eqNullSafe(F.col("host")))
    return both.where((F.col("pages") >= min_pages) & (F.col("n") > ratio * F.col("pages"))).select("host", "line", "n", "pages")


def line_dedup(pages: DataFrame, host: Column, lines: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, min_copies: int = MIN_COPIES, spare_copies: bool = False, limit: int = SMALL_LINES, salts: int = SALTS) -> DataFrame:
    """row (a struct of the page's columns), lines (the kept ones), n_lines and n_dropped (without blank lines).

    spare_copies: a page that would lose all its lines keeps those that are not boilerplate where exact copies count as one page.
    """
    none = F.array().cast("array<bigint>")
    bad = cut(boilerplate(pages, host, lines, ratio, min_pages, min_copies).groupBy("host").agg(F.collect_set("line").alias("bad")))
    if spare_copies:
        once = cut(boilerplate(pages, host, lines, ratio, min_pages, min_copies, True).groupBy("host").agg(F.collect_set("line").alias("once")).withColumnRenamed("host", "h"))
        bad = cut(bad.join(once, F.col("host").eqNullSafe(F.col("h")), "left").select("host", "bad", F.coalesce("once", none).alias("once")))
    else:
        bad = bad.withColumn("once", none)
    tagged = pages.select(F.struct("*").alias("row"), host.alias("host"), F.coalesce(lines, F.array().cast("array<string>")).alias("lines"))
    if (bad.agg(F.sum(F.size("bad"))).first()[0] or 0) <= limit:
        met = tagged.join(F.broadcast(bad.withColumnRenamed("host", "h")), F.col("host").eqNullSafe(F.col("h")), "left")
    else:
        dealt = bad.select(F.col("host").alias("h"), "bad", "once", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
        salt = F.pmod(F.xxhash64("lines"), F.lit(salts)).cast("int")
        met = tagged.withColumn("salt", salt).join(dealt, F.col("host").eqNullSafe(F.col("h")) & (F.col("salt") == F.col("s")), "left")
    hashes = F.transform("lines", lambda x: F.xxhash64(x))
    met = met.withColumn("hit", F.array_intersect(hashes, F.coalesce("bad", none)))
    dropped = lambda x, of: (x != "") & F.array_contains(F.col(of), F.xxhash64(x))
    kept = F.when(F.size("hit") == 0, F.col("lines")).otherwise(F.filter("lines", lambda x: ~dropped(x, "hit")))
    out = met.select("row", "lines", "once", kept.alias("kept"), F.size(F.filter("lines", lambda x: x != "")).cast("long").alias("n_lines"))
    left = F.size(F.filter("kept", lambda x: x != "")).cast("long")
    if spare_copies:
        out = out.withColumn("kept", F.when((left > 0) | (F.col("n_lines") == 0), F.col("kept")).otherwise(F.filter("lines", lambda x: ~dropped(x, "once"))))
    return out.select("row", F.col("kept").alias("lines"), "n_lines", (F.col("n_lines") - left).alias("n_dropped"))


def html_lines(html: Column) -> Column:
    flat = F.regexp_replace(F.regexp_replace(html, SCRIPT_RE, "\n"), TAG_RE, "\n")
    return F.transform(F.split(flat, "\n"), lambda x: F.trim(x))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every page: its lines, how many of them are its host's boilerplate, and the digest of the rest."""
    host = F.nullif(F.lower(F.regexp_extract("url", HOST_RE, 1)), F.lit(""))
    out = line_dedup(read(spark, sf_dir, "pages").select("page_id", "url", "html"), host, html_lines(F.col("html")))
    return out.select("row.page_id", "n_lines", "n_dropped", F.sha2(F.array_join("lines", "\n"), 256).alias("kept_sha256"))


OP3_SQL = f"""
WITH split AS (
  SELECT page_id, row_number() OVER () AS rid, nullif(lower(regexp_extract(url, '{HOST_RE}', 1)), '') AS host,
         coalesce(list_transform(string_split(regexp_replace(regexp_replace(html, '{SCRIPT_RE}', chr(10), 'g'), '{TAG_RE}', chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')), []) AS lines
  FROM pages),
each AS (SELECT DISTINCT rid, host, line FROM (SELECT rid, host, unnest(lines) AS line FROM split) WHERE line <> ''),
total AS (SELECT host, count(*) AS pages FROM split GROUP BY host),
bad AS (
  SELECT e.host, e.line FROM each e JOIN total t ON e.host IS NOT DISTINCT FROM t.host
  GROUP BY e.host, e.line, t.pages
  HAVING count(*) >= {MIN_COPIES} AND t.pages >= {MIN_PAGES} AND count(*) > {RATIO}::DOUBLE * t.pages),
hosts AS (SELECT host, list(line) AS bad FROM bad GROUP BY host),
met AS (SELECT s.page_id, s.lines, coalesce(h.bad, []) AS bad FROM split s LEFT JOIN hosts h ON s.host IS NOT DISTINCT FROM h.host),
kept AS (SELECT page_id, lines, list_filter(lines, lambda x: NOT list_contains(bad, x)) AS kept FROM met)
SELECT page_id, len(list_filter(lines, lambda x: x <> ''))::BIGINT AS n_lines,
       (len(lines) - len(kept))::BIGINT AS n_dropped, sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
FROM kept
"""
