"""Numbering, gating and the cache of references, and the pages that web references are expanded by."""

import random

from pyspark.sql import functions as F

from loomspan.operators import references as R
from loomspan.plans import catalog, overlap, retrieval
from loomspan.sources import providers

COLUMNS = "query string, rank int, title string, url string, text string, source string"


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_numbers_follow_frames_queries_and_ranks(spark):
    rnd = random.Random(1)
    rows = [[(rnd.choice("abc"), i, f"t{f}", f"u{f}/{i}", "", "arXiv") for i in range(n)] for f, n in enumerate((700, 0, 90))]
    for own in rows:
        rnd.shuffle(own)
    got = retrieval.numbered([frame(spark, own) for own in rows]).select("ref_id", "url").collect()
    want = [r[3] for own in rows for r in sorted(own, key=lambda r: (r[0], r[1]))]
    assert [r.url for r in sorted(got)] == want and [r.ref_id for r in sorted(got)] == list(range(1, len(want) + 1))


def references(rnd, query, service, n):
    return [(query, i, f"{service} {i}", f"https://x/{rnd.randrange(60)}" if rnd.random() < 0.5 else "", f"text {i % 9}", service) for i in range(n)]


def test_topics_of_many_queries_are_as_one_by_one(spark):
    rnd = random.Random(2)
    sizes = {"a": (30, 5, 5, 9), "b": (3, 30, 7, 2), "c": (2, 2, 2, 0), "d": (0, 0, 4, 40), "e": (10, 13, 2, 1)}
    services = ["Crossref", "arXiv", "DOAJ"]
    rows = {s: [r for q in sizes for r in references(rnd, q, s, sizes[q][k])] for k, s in enumerate(services)}
    pages = [r for q in sizes for r in references(rnd, q, "Wikipedia", sizes[q][3])]
    papers, web = {s: frame(spark, r).cache() for s, r in rows.items()}, frame(spark, pages).cache()
    got = {}
    for r in retrieval.topic_tables(papers, web).collect():
        got.setdefault(r.query, []).append((r.position, r.title))
    asked = {r.query: set() for r in retrieval.gated(papers).select("query").distinct().collect()}
    for r in retrieval.gated(papers).select("query", "service").distinct().collect():
        asked[r.query].add(r.service)
    assert asked == {"a": {"Crossref"}, "b": {"Crossref", "arXiv"}, "c": set(services), "d": {"DOAJ"}, "e": {"Crossref", "arXiv", "DOAJ"}}
    for q in ("a", "b", "d"):
        one = retrieval.topic_references({s: p.where(F.col("query") == q) for s, p in papers.items()}, web.where(F.col("query") == q)).collect()
        assert sorted(got[q]) == sorted((r.position, r.title) for r in one)


def test_cache_fetches_what_the_rule_names(spark, tmp_path):
    cache = retrieval.Cache(spark, str(tmp_path / "cache"), "id long, mode string, query string, key string, payload string")
    kinds = "id long, mode string, query string, key string"
    first = spark.createDataFrame([(1, "topic", "q", "k"), (2, "url", "https://x", "k"), (3, "web", None, None)], kinds)
    fetch, keep = retrieval.refreshed(cache.read(), first)
    assert fetch.count() == 3 and keep.count() == 0
    cache.replace(retrieval.upserted(cache.read(), fetch.withColumn("payload", F.lit("one"))))
    again = spark.createDataFrame([(1, "topic", "q", "k"), (2, "url", "https://x", "k"), (3, "web", None, "new"), (4, "topic", "z", "k")], kinds)
    fetch, keep = retrieval.refreshed(cache.read(), again)
    assert sorted(r.id for r in fetch.collect()) == [2, 3, 4] and [(r.id, r.payload) for r in keep.collect()] == [(1, "one")]
    cache.replace(retrieval.upserted(cache.read(), fetch.withColumn("payload", F.lit("two"))))
    assert sorted((r.id, r.key, r.payload) for r in cache.read().collect()) == [(1, "k", "one"), (2, "k", "two"), (3, "new", "two"), (4, "k", "two")]


def test_a_page_reaches_the_web_references(spark):
    """An item's address is a page's, and what the page says changes how the item ranks."""
    words = "the quick analysis of results shows that methods and outcomes compare well with earlier findings across several groups of students in every measured year"
    target = spark.createDataFrame([(1, words)], "doc_id long, text string")
    web = spark.createDataFrame([(1, i, f"Title {i}", f"https://x/{i}", t, "DuckDuckGo") for i, t in enumerate(["methods and outcomes compare", "unrelated snippet about ships"])], "doc_id long, ref_id long, title string, url string, text string, source string")
    page = spark.createDataFrame([("https://x/1", "A page", words + " " + words)], "url string, page_title string, page_text string")
    without = {r.ref_id: (r.position, r.text) for r in retrieval.web_references(target, web).collect()}
    with_page = {r.ref_id: (r.position, r.text) for r in retrieval.web_references(target, web, page).collect()}
    assert without[0][0] == 1 and with_page[1][0] == 1
    assert with_page[1][1].endswith(words) and without[1][1] == "unrelated snippet about ships"


def test_items_have_addresses_of_pages_and_nothing_stays_cached(spark):
    sf = "/root/testdata/sf0.001"
    items = catalog._web_items(spark, sf).select("url").distinct().collect()
    urls = {r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert items and all(r.url in urls for r in items)
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert catalog.doc_overlap_pct(spark, sf).count() == 200
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


def test_saved_references_are_checked_against_alike(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    refs = catalog._refs(spark, sf)
    spark.sql("CREATE DATABASE IF NOT EXISTS kept_references")
    overlap.References.of(refs).save("kept_references.items", 4)
    loaded = overlap.References.load(spark, "kept_references.items")
    assert sorted(overlap.check(docs, loaded)[1].collect()) == sorted(overlap.check(docs, refs)[1].collect())
    spark.sql("DROP DATABASE kept_references CASCADE")
    assert providers.WEB_SOURCES and R.reference_key() is not None
