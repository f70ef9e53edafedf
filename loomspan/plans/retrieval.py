"""Reference retrieval over tables of payloads: which sources are taken, in which order, how expanded."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.operators import references as R
from loomspan.plans import overlap
from loomspan.session import settled
from loomspan.sources import providers

#: Web services in the order they are asked, the one that is asked when none of them is accepted, the
#: score that a source without a match must reach, and how many references of a service are looked at.
CASCADE = ["DuckDuckGo", "Grokipedia", "Wikipedia"]
LAST = "SerpApi"
ACCEPTED = 1.5
POOL, QUERIES = 24, 4


def numbered(frames: list[DataFrame], order: tuple[str, ...] = ("query", "rank")) -> DataFrame:
    """One table with ref_id from 1 in the order of the frames, then of query and rank.

    In two passes: rows are dealt into ranges of that order and counted by range, and each range is numbered
    on from the sum of those before it, so no task sees more than its range. Ranges come from a sample;
    the dealt rows are written once, so that both passes see the same ones.
    """
    rows = reduce(lambda a, b: a.unionByName(b), [f.withColumn("_p", F.lit(i)) for i, f in enumerate(frames)])
    by = ["_p", *order]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settled(rows.repartitionByRange(parts, *by).withColumn("_range", F.spark_partition_id()))
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))  # a row per partition
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).select("_range", F.coalesce("_before", F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*by))
    return dealt.join(F.broadcast(before), "_range").withColumn("ref_id", (F.col("_before") + place).cast("long")).drop("_p", "_range", "_before")


def web_choice(targets: DataFrame, web: DataFrame, key: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """doc_id, source, score, matches, taken: what each service's references show of a text.

    ``web`` has doc_id, ref_id, title, url, text, source. Of each service of the cascade a pool of
    references is ranked by overlap and the best are kept; of the last service the first ``most`` are. A
    service is accepted if a quick check finds a match or reaches the score; the first accepted one is
    taken, otherwise the one with the highest score, the earlier of equals, the last service last.
    """
    order = F.array_position(F.array(*[F.lit(s) for s in [*CASCADE, LAST]]), F.col("source"))
    pool = min(POOL, max(8, 3 * most, most * max(3, QUERIES)))
    web = settled(web.where(F.col("source").isin([*CASCADE, LAST])))
    last = R.deduplicate(web.where(F.col("source") == LAST), most, ("doc_id", "source"))
    first = R.deduplicate(web.where(F.col("source").isin(CASCADE)), pool, ("doc_id", "source"))
    # each (text, service) is a target of its own with a group of its own
    asked = first.withColumn("_pair", F.to_json(F.struct("doc_id", "source")))
    texts = asked.select("_pair", F.col("doc_id").alias("_d")).distinct().join(targets.select(F.col(key).alias("_d"), F.col(text).alias("_t")), "_d").select("_pair", "_t")
    ranked = R.rerank(texts, asked.select(F.col("_pair").alias("doc_id"), "ref_id", "title", "text"), "_pair", "_t").where(F.col("position") <= max(2 * most, 6))
    kept = ranked.select(F.col("doc_id").alias("_pair"), "ref_id")
    own = asked.join(kept, ["_pair", "ref_id"]).select(first.columns)
    own = settled(own.unionByName(last))
    pair = own.select(F.col("doc_id").alias("_d"), F.col("source").alias("_s")).distinct().withColumn("pair_id", F.to_json(F.struct("_d", "_s")))
    tried = pair.join(targets.select(F.col(key).alias("_d"), F.col(text).alias("_t")), "_d").select("pair_id", F.col("_t").alias("text"))
    refs = own.join(pair, (F.col("doc_id") == F.col("_d")) & (F.col("source") == F.col("_s"))).select("ref_id", F.col("pair_id").alias("group_id"), "title", "url", "source", "text")
    seen = overlap.finished(overlap.snapshot(tried, refs, "pair_id", "text"))
    found = pair.join(seen.withColumnRenamed("doc_id", "pair_id"), "pair_id").select(F.col("_d").alias("doc_id"), F.col("_s").alias("source"), "score", "matches")
    good = (F.col("matches") > 0) | (F.col("score") >= ACCEPTED)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(good), F.when(good, F.lit(0.0)).otherwise(-F.col("score")), order))
    return found.withColumn("taken", place == 1)


def web_references(targets: DataFrame, web: DataFrame, pages: DataFrame | None = None, key: str = "doc_id", text: str = "text", most: int = 3) -> DataFrame:
    """doc_id, ref_id, title, url, text, source, position: up to three web references of each text.

    The taken service's references without doubles, ranked, the first ones expanded by the text of their
    pages (url, page_title, page_text), ranked again.
    """
    web = settled(web)
    taken = web_choice(targets, web, key, text, most).where("taken").select("doc_id", "source")
    own = settled(R.deduplicate(web.join(taken, ["doc_id", "source"]), 0, ("doc_id",)))
    ranked = R.rerank(targets, own, key, text).where(F.col("position") <= max(2 * most, 6)).select("doc_id", "ref_id")
    own = settled(own.join(ranked, ["doc_id", "ref_id"]))
    if pages is not None:
        own = settled(R.deduplicate(R.expand(own, pages, providers.WEB_SOURCES).drop("snippet"), 0, ("doc_id",)))
    ranked = R.rerank(targets, own, key, text).where(F.col("position") <= most).select("doc_id", "ref_id", "position")
    return own.join(ranked, ["doc_id", "ref_id"])


def stale(mode: Column, query: Column, key: Column, before: Column) -> Column:
    """Whether cached references must be fetched anew: for an address always, else if anything changed.

    ``before`` is the cached entry, a struct of mode, query and key, or null.
    """
    same = mode.eqNullSafe(before["mode"]) & query.eqNullSafe(before["query"]) & key.eqNullSafe(before["key"])
    return before.isNull() | (mode == "url") | ~same


def refreshed(cache: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what to fetch, what may be kept) of a cache table for the entries asked for now.

    Both have id, mode, query and key, ``cache`` its payload columns besides. An entry is fetched if it is
    not there, is an address or has changed (``stale``); the kept ones come with their payload.
    """
    before = cache.select(F.col("id").alias("_id"), F.struct("mode", "query", "key").alias("_before"))
    known = asked.join(before, F.col("id") == F.col("_id"), "left").withColumn("_stale", stale(F.col("mode"), F.col("query"), F.col("key"), F.col("_before")))
    fetch = known.where("_stale").select(asked.columns)
    return fetch, cache.join(known.where("NOT _stale").select("id"), "id", "left_semi")


def upserted(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """The cache with the fetched entries in place of those with the same id."""
    return cache.join(fetched.select("id").distinct(), "id", "left_anti").unionByName(fetched)


class Cache:
    """A keyed table of fetched references in a folder that all executors share.

    Each version is written whole beside the last and then named in the folder's ``current`` table, which is
    what readers follow: a job that fails half-way leaves the version before. Writers are one at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _version(self) -> int:
        try:
            return self.spark.read.schema("version long").parquet(f"{self.folder}/current").agg(F.max("version")).first()[0] or 0
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return 0
            raise

    def read(self) -> DataFrame:
        """The latest version; an empty table before the first."""
        version = self._version()
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{version}") if version else self.spark.createDataFrame([], self.schema)

    def replace(self, entries: DataFrame) -> None:
        version = self._version() + 1
        entries.select(self.read().columns).write.mode("overwrite").parquet(f"{self.folder}/v{version}")
        self.spark.createDataFrame([(version,)], "version long").coalesce(1).write.mode("append").parquet(f"{self.folder}/current")


def gated(papers: dict[str, DataFrame], most: int = 24) -> DataFrame:
    """The papers of every query, service by service, while the services before gave fewer than ``most``.

    ``papers`` maps services in the order in which they are asked to tables of parsed references with
    query and rank. Each query is gated by its own counts: a running sum over a row for each query and
    service, so any number of queries goes through in one plan. Returns the rows with ``service``.

    A table may have a page: later pages of a service are asked for while fewer than twice ``most`` are there.
    """
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.withColumn("service", F.lit(name)).withColumn("_at", F.lit(i)) for i, (name, f) in enumerate(papers.items())])
    rows = rows.withColumn("_page", F.coalesce("page", F.lit(1))).drop("page") if "page" in rows.columns else rows.withColumn("_page", F.lit(1))
    counts = rows.groupBy("query", "_at", "_page").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("query").orderBy("_at", "_page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("_before", before).withColumn("_start", F.min("_before").over(Window.partitionBy("query", "_at")))
    asked = counts.where((F.col("_start") < most) & ((F.col("_page") == 1) | (F.col("_before") < 2 * most))).select(F.col("query").alias("_q"), F.col("_at").alias("_a"), F.col("_page").alias("_p"))
    on = F.col("query").eqNullSafe(F.col("_q")) & (F.col("_at") == F.col("_a")) & (F.col("_page") == F.col("_p"))
    return rows.join(asked, on, "left_semi").drop("_at", "_page")


def topic_tables(papers: dict[str, DataFrame], web: DataFrame | None = None, most: int = 24, web_most: int = 3) -> DataFrame:
    """query, position and the references of every query: papers gated by service, web pages, blended.

    Doubles within a query go, the first of them stays: papers before web pages, in the order of services and ranks.
    Of a query at most ``most`` stay: papers first, then up to ``web_most`` web pages, as ``blend`` does for one.
    """
    order = F.create_map(*[x for i, name in enumerate(papers) for x in (F.lit(name), F.lit(i))])
    own = gated(papers, most).withColumn("_web", F.lit(False)).withColumn("_at", F.try_element_at(order, F.col("service"))).drop("service")
    if web is not None:
        own = own.unionByName(web.select([c for c in own.columns if c not in ("_web", "_at")]).withColumns({"_web": F.lit(True), "_at": F.lit(len(papers))}))
    first = F.row_number().over(Window.partitionBy("query", R.reference_key()).orderBy("_at", "rank"))
    own = own.withColumn("_first", first).where("_first = 1").drop("_first")
    kind = F.coalesce(F.col("source").isin(providers.WEB_SOURCES), F.lit(False))
    own = own.withColumn("_web", kind).withColumn("_n", F.row_number().over(Window.partitionBy("query", "_web").orderBy("_at", "rank"))).where(F.col("_n") <= most)
    pages = F.least(F.lit(web_most), F.sum(F.col("_web").cast("int")).over(Window.partitionBy("query")))
    own = own.withColumn("_pages", pages)
    chosen = F.when(F.col("_web"), F.col("_n") <= web_most).otherwise(F.col("_n") <= F.greatest(F.lit(0), F.lit(most) - F.col("_pages")))
    part = F.when(~chosen, 2).when(F.col("_web"), 1).otherwise(0)
    place = F.row_number().over(Window.partitionBy("query").orderBy("_part", "_at", "rank"))
    own = own.withColumn("_part", part).withColumn("position", place).where(F.col("position") <= most)
    return own.drop("_web", "_at", "_n", "_pages", "_part")


def topic_references(papers: dict[str, DataFrame], web: DataFrame | None = None, most: int = 24) -> DataFrame:
    """References of one topic: papers service by service while fewer than ``most``, then web, blended.

    ``papers`` maps services in order to tables of parsed references; a later service is read only if the
    earlier ones gave too few. ``web`` has the same columns. ``topic_tables`` does the same for many queries.
    """
    frames: list[DataFrame] = []
    count = 0
    for frame in papers.values():
        if count < most:
            frames.append(frame)
            count += frame.limit(most).count()
    own = numbered([*frames, *([web.select(frames[0].columns)] if web is not None else [])])
    return R.blend(R.deduplicate(own), providers.WEB_SOURCES, most)


def by_mode(query: str, papers: dict[str, DataFrame], web: DataFrame, pages: DataFrame, most: int = 24) -> DataFrame:
    """References for a query: a page for an address, papers and web for a topic, web alone for none."""
    from loomspan.functions.html import reference_from_page

    mode = papers[next(iter(papers))].sparkSession.range(1).select(T.reference_mode(F.lit(query)).alias("m")).first()["m"]
    if mode == "url":
        return reference_from_page(pages.where(F.col("url") == query))
    return topic_references(papers, web, most) if mode == "topic" else R.deduplicate(numbered([web]), most)
