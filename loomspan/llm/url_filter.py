"""URL filters: a sort-merge range join over reversed-host keys.

A host is written with its labels reversed and each ended by a comma (``blog.example.net`` becomes
``net,example,blog,``), so a rule for a host and all its subdomains is the interval of keys that start
with the rule's key. URLs and rules are cut by the same range bounds; a rule is copied to each range
that its interval overlaps, and a range's rows are swept in key order with a stack of the rules that
are open, each nested in the one below. The stack is walked from the deepest rule up, and of those
whose path the URL's path starts with, the longest wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import table

#: host, path, verdict
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
END = "\U0010ffff"  # above every character of a key


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit(""))
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The reversed labels, each with a comma; an empty host has an empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(",")))


def bounds_of(keys: DataFrame, ranges: int, sample: int = 20_000) -> list[str]:
    """Upper bounds of the ranges, at most ``ranges`` - 1 strings.

    They come from a sample of ``sample`` keys or fewer in expectation, which only decides how evenly
    rows are dealt; a key that very many rows share appears as several equal bounds and its rows are
    dealt over all the ranges between them.
    """
    n = keys.count()
    got = sorted(r[0] for r in (keys.sample(min(1.0, sample / n), seed=1) if n > sample else keys).collect())
    return [got[len(got) * i // ranges] for i in range(1, ranges)] if got else []


def below(bounds: list[str], key: Column, equal: bool) -> Column:
    """How many of the sorted bounds are less than a key (or equal): the heads of groups first, then one group.

    With groups as long as there are many, a row is compared with the root of the bounds' number.
    """
    if not bounds:
        return F.lit(0)
    step = max(4, isqrt(len(bounds)))
    less = (lambda b: b <= key) if equal else (lambda b: b < key)
    heads = F.array(*[F.lit(b) for b in bounds[::step]])
    groups = F.array(*[F.array(*[F.lit(b) for b in bounds[i : i + step]]) for i in range(0, len(bounds), step)])
    group = F.greatest(F.size(F.filter(heads, less)) - 1, F.lit(0))
    return group * step + F.size(F.filter(F.get(groups, group), less))


def placed(bounds: list[str], key: Column, salt: Column | None) -> Column:
    """The range of a key; equal bounds are told apart by the salt."""
    low, high = below(bounds, key, False), below(bounds, key, True)
    return (low + F.pmod(salt, high - low + 1)).cast("int")


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rules and URLs in (part, key, kind, rule) order to one row per URL with its rule."""
    stack: list[tuple[str, str, str, str]] = []
    part = None
    for b in batches:
        c = b.to_pydict()
        ids, urls, hosts, paths, rules, verdicts = [], [], [], [], [], []
        for p, key, kind, i, url, host, path, rule, verdict in zip(*(c[k] for k in ("part", "key", "kind", "page_id", "url", "host", "path", "rule", "verdict")), strict=True):
            if p != part:
                part, stack = p, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, path, rule, verdict))
                continue
            best = None
            for open_rule in reversed(stack):
                if path.startswith(open_rule[1]) and (best is None or (len(open_rule[2]), open_rule[2]) > (len(best[2]), best[2])):
                    best = open_rule
            ids.append(i)
            urls.append(url)
            hosts.append(host)
            paths.append(path)
            rules.append(best and best[2])
            verdicts.append(best and best[3])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.string()) for x in (hosts, paths, rules, verdicts))], names=["page_id", "host", "path", "rule", "verdict"])


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", ranges: int | None = None) -> DataFrame:
    """Judge every URL of ``pages`` by ``rules`` (host, path, verdict).

    Returns page_id, host, path, rule (host and path of the winning rule, else null) and verdict (the
    rule's, else ``default``). The longest rule text wins; between equally long ones the later in code
    point order, between verdicts of one rule ``block``. Null URLs and those without ``://`` have an
    empty host, which no rule fits. Repeated rows keep their number, null ids stay null, an empty
    table gives no rows, and other columns are left out.
    """
    ranges = ranges or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    urls = urls.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).withColumn("key", host_key(F.col("host")))
    bounds = bounds_of(urls.select("key"), ranges)
    urls = urls.select(
        placed(bounds, F.col("key"), F.xxhash64("page_id", "path")).alias("part"), "key", F.lit(1).alias("kind"), "page_id", F.lit(None).cast("string").alias("url"), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")
    )
    rules = rules.where("host IS NOT NULL AND host <> ''").groupBy(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.max(F.struct((F.col("verdict") == "block").alias("b"), "verdict"))["verdict"].alias("verdict"))
    rules = rules.withColumn("key", host_key(F.col("host")))

    low, high = below(bounds, F.col("key"), False), below(bounds, F.concat("key", F.lit(END)), True)
    rules = rules.select(F.explode(F.sequence(low, high)).alias("part"), "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), "host", "path", F.concat("host", "path").alias("rule"), "verdict")
    rows = urls.unionByName(rules).repartitionById(ranges, "part").sortWithinPartitions("part", "key", "kind", "rule")
    return rows.mapInArrow(sweep, "page_id long, host string, path string, rule string, verdict string").withColumn("verdict", F.coalesce("verdict", F.lit(default)))


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), default_rules(spark))


ORACLE_SQL = """
WITH split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path
  FROM split
), rules(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT p.page_id, p.host, p.path, max_by(rh || rp, length(rh || rp)) AS rule, max_by(rv, length(rh || rp)) AS verdict
  FROM parts p LEFT JOIN rules ON (p.host = rh OR ends_with(p.host, '.' || rh)) AND starts_with(p.path, rp)
  GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
"""
