"""Line dedup by site-relative frequency, in DataFrame operations only.

Pages are grouped by host; a line is boilerplate of its host when the share of the host's pages that
contain it exceeds a ratio. Counting is by partial sums per (host, line), so a host with a third of
all pages is spread by its lines. As each boilerplate line uses up more than ``ratio`` of a host's
pages, a host has fewer than (distinct lines a page) / ``ratio`` of them, however many pages it has;
these short lists are what meets the pages again. A host with very many pages is split for that: its
pages are dealt over as many parts as it is large, and its list is copied to each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import shared_checkpoint, split_join, table
from loomspan.llm.url_filter import host_of

#: Elements whose content is no text, and tags that end a line.
SILENT = r"(?is)<(script|style|noscript|template)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>"
BREAKING = r"(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"


def page_lines(html: Column) -> Column:
    """The visible lines of a page: tags that break lines do so, others vanish, blanks collapse."""
    text = F.regexp_replace(F.regexp_replace(html, SILENT, "\n"), r"[ \t\r\n]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, BREAKING, "\n"), r"<[^>]*>", "")
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def site_line_dedup(pages: DataFrame, lines: Column, host: Column, id_col: str = "page_id", ratio: float = 0.3, min_pages: int = 1) -> DataFrame:
    """Drop from every page the lines that more than ``ratio`` of its host's pages contain.

    ``lines`` is an array column and ``host`` a string column of ``pages``. Returns page_id, host,
    host_pages, n_lines, n_dropped and text (the kept lines, in order, joined by line feeds). A line is
    compared trimmed and exactly, and counts once for each page however often it stands there; all its
    occurrences are dropped. The ratio alone decides: with the default every line of a host of up to
    three pages exceeds it, as it stands on a third of the pages or more. ``min_pages`` is for who wants
    hosts with fewer pages left as they are. A null host is a host of its own, written as empty; null
    lines count as none. Null ids stay null, repeated rows are pages of their own, an empty table gives
    no rows, and other columns are left out.
    """
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(lines, F.array().cast("array<string>")).alias("lines"))
    total = shared_checkpoint(own.groupBy("host").agg(F.count("*").alias("host_pages")))
    # two independent digests stand for a line
    digest = lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(x, F.lit(1)).alias("b"))
    seen = own.select("host", F.explode(F.array_distinct(F.filter("lines", lambda x: x.isNotNull()))).alias("line")).select("host", F.xxhash64("line").alias("a"), F.xxhash64("line", F.lit(1)).alias("b"))
    counts = seen.groupBy("host", "a", "b").agg(F.count("*").alias("n"))
    often = split_join(counts, total.where(F.col("host_pages") >= min_pages), "host", "host_pages", F.col("a")).where(F.col("n") > F.col("host_pages") * ratio)
    drop = shared_checkpoint(total.join(often.groupBy("host").agg(F.collect_set(F.struct("a", "b")).alias("drop")), "host", "left"))
    joined = split_join(own, drop, "host", "host_pages", F.xxhash64("page_id", "lines"))
    kept = F.filter("lines", lambda x: x.isNotNull() & (F.col("drop").isNull() | ~F.array_contains(F.col("drop"), digest(x))))
    joined = joined.withColumn("lines", F.filter("lines", lambda x: x.isNotNull())).withColumn("kept", kept)
    return joined.select("page_id", "host", "host_pages", F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_line_dedup(table(spark, sf_dir, "pages"), page_lines(F.col("html")), host_of(F.col("url")))


ORACLE_SQL = r"""
WITH own AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
           '(?is)<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<noscript\b[^>]*>.*?</noscript\s*>|<template\b[^>]*>.*?</template\s*>|<!--.*?-->|<!doctype[^>]*>', chr(10), 'g'),
           '[ \t\r\n]+', ' ', 'g'),
           '(?i)</?(address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>', chr(10), 'g'),
           '<[^>]*>', '', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines
  FROM pages
), total AS (SELECT host, count(*) AS host_pages FROM own GROUP BY host),
often AS (
  SELECT s.host, s.line FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM own) s JOIN total USING (host)
  GROUP BY s.host, s.line, host_pages HAVING count(*) > host_pages * 0.3
), dropped AS (SELECT host, list(line) AS gone FROM often GROUP BY host),
kept AS (
  SELECT page_id, host, host_pages, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS k
  FROM own JOIN total USING (host) LEFT JOIN dropped USING (host)
)
SELECT page_id, host, host_pages, len(lines) AS n_lines, len(lines) - len(k) AS n_dropped, array_to_string(k, chr(10)) AS text FROM kept
"""
