"""Search and paper services: their payloads as columns to references.

Nothing here talks to a network. A table of payloads, (query, payload) as text, comes from whatever
fetched them; each parser turns it into title, url, text, source rows with the query and the rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import text as T
from loomspan.functions.html import strip_tags
from loomspan.operators.references import reference_key

# How services mark their results.
LINKS = r"(?is)<a(?=[^>]*class=['\"][^'\"]*result-link[^'\"]*['\"])(?=[^>]*href=['\"]([^'\"]+)['\"])[^>]*>(.*?)</a>"
SNIPPETS = r"(?is)<td[^>]+class=['\"][^'\"]*result-snippet[^'\"]*['\"][^>]*>(.*?)</td>"
ANCHORS = r"(?is)<a[^>]+href=\"([^\"]+)\"[^>]*>(.*?)</a>"
PARAGRAPHS = r"(?is)<p[^>]*>(.*?)</p>"
HOME = "https://grokipedia.com"
WEB_SOURCES = ["DuckDuckGo", "Grokipedia", "Wikipedia", "SerpApi"]


def _rows(df: DataFrame, title: Column, url: Column, text: Column, source: str, keep: Column) -> DataFrame:
    return df.where(keep).select("query", "rank", title.alias("title"), url.alias("url"), text.alias("text"), F.lit(source).alias("source"))


def _zipped(df: DataFrame, links: str, snippets: str) -> DataFrame:
    """query, rank, link, title, snippet: links and snippets paired by position."""
    body = F.coalesce("payload", F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(body, F.lit(links), F.lit(1)).alias("link"), F.regexp_extract_all(body, F.lit(links), F.lit(2)).alias("title"), F.regexp_extract_all(body, F.lit(snippets), F.lit(1)).alias("snippet"))
    out = df.select("query", F.posexplode(pairs).alias("rank", "x")).where(F.col("x.link").isNotNull())
    return out.select("query", "rank", F.col("x.link").alias("link"), strip_tags(F.col("x.title")).alias("name"), strip_tags(F.col("x.snippet")).alias("snippet"))


def duckduckgo(payloads: DataFrame, most: int = 10) -> DataFrame:
    """Result pages in HTML; links through the redirect are unwrapped, snippets below 30 letters dropped."""
    own = _zipped(payloads, LINKS, SNIPPETS).where(F.col("rank") < most)
    redirect = F.col("link").rlike(r"^(//duckduckgo\.com)?/l/\?")
    full = F.when(F.col("link").startswith("//"), F.concat(F.lit("https:"), "link")).otherwise(F.concat(F.lit("https://duckduckgo.com"), "link"))
    target = F.try_url_decode(F.try_parse_url(F.replace(full, F.lit("&amp;"), F.lit("&")), F.lit("QUERY"), F.lit("uddg")))
    url = F.when(redirect & (F.coalesce(target, F.lit("")) != ""), target).otherwise(F.col("link"))
    return _rows(own, F.substring("name", 1, 200), url, F.substring("snippet", 1, 1500), "DuckDuckGo", F.length("snippet") >= 30)


def wikipedia(searches: DataFrame, extracts: DataFrame, most: int = 5) -> DataFrame:
    """``searches``: [query, titles, descriptions, addresses]; ``extracts``: (title, payload) of the pages' intros."""
    arrays = F.from_json("payload", "array<string>")
    part = lambda i: F.from_json(F.get(arrays, F.lit(i)), "array<string>")
    hits = searches.select("query", F.posexplode(F.slice(F.arrays_zip(part(1).alias("title"), part(3).alias("url")), 1, most)).alias("rank", "x")).where(F.col("x.title").isNotNull())
    hits = hits.select("query", "rank", F.col("x.title").alias("title"), F.coalesce("x.url", F.lit("")).alias("url"))
    body = F.from_json("payload", "query struct<pages:map<string,struct<extract:string>>>")
    long = F.filter(F.map_values(body["query"]["pages"]), lambda p: F.length(F.coalesce(p["extract"], F.lit(""))) >= 100)
    intro = extracts.select("title", F.get(long, F.lit(0))["extract"].alias("_x")).where(F.col("_x").isNotNull()).groupBy("title").agg(F.min("_x").alias("_x"))
    return _rows(hits.join(intro, "title"), F.col("title"), F.col("url"), F.substring("_x", 1, 3000), "Wikipedia", F.lit(True))


_ITEM = "struct<title:string,url:string,link:string,snippet:string,summary:string,description:string>"


def _first(*names: str) -> Column:
    return T.collapse(F.coalesce(*[F.nullif(F.col(f"x.{n}"), F.lit("")) for n in names], F.lit("")))


def grokipedia(payloads: DataFrame, most: int = 10) -> DataFrame:
    """JSON results under ``results`` or ``items`` or bare; pages in HTML where there are none. Doubles of a query go."""
    body = F.from_json("payload", f"results array<{_ITEM}>, items array<{_ITEM}>")
    bare = F.from_json("payload", f"array<{_ITEM}>")
    pick = lambda a, b: F.when(F.size(F.coalesce(a, F.array())) > 0, a).otherwise(b)
    listed = F.when(F.ltrim("payload").startswith("["), bare).otherwise(pick(body["results"], body["items"]))
    own = payloads.select("query", F.posexplode(F.slice(listed, 1, most)).alias("rank", "x"))
    title, url, text = _first("title"), _first("url", "link"), _first("snippet", "summary", "description")
    found = _rows(own, F.when(title == "", "Untitled").otherwise(F.substring(title, 1, 200)), url, F.substring(text, 1, 1800), "Grokipedia", (url != "") & (F.length(text) >= 45))
    pages = _zipped(payloads.join(found.select("query").distinct(), "query", "left_anti").where(F.ltrim("payload").startswith("<")), ANCHORS, PARAGRAPHS)
    link = F.when(F.col("link").startswith("/"), F.concat(F.lit(HOME), "link")).otherwise(F.col("link"))
    read = _rows(pages, F.substring("name", 1, 200), link, F.substring("snippet", 1, 1800), "Grokipedia", (F.length("name") >= 6) & link.startswith("http") & (F.length("snippet") >= 60))
    read = read.withColumn("_n", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where(F.col("_n") <= most).drop("_n")
    first = F.row_number().over(Window.partitionBy("query", reference_key()).orderBy("rank"))
    return found.unionByName(read).withColumn("_first", first).where("_first = 1").drop("_first")


def serpapi(payloads: DataFrame, most: int = 10) -> DataFrame:
    body = F.from_json("payload", f"organic_results array<{_ITEM}>")
    own = payloads.select("query", F.posexplode(F.slice(body["organic_results"], 1, most)).alias("rank", "x"))
    title, url, text = _first("title"), _first("link"), _first("snippet")
    return _rows(own, F.when(title == "", "Untitled").otherwise(F.substring(title, 1, 200)), url, F.substring(text, 1, 1800), "SerpApi", (url != "") & (F.length(text) >= 45))


def _doi(url: Column, doi: Column) -> Column:
    return F.when(url != "", url).when(F.coalesce(doi, F.lit("")) != "", F.concat(F.lit("https://doi.org/"), doi)).otherwise("")


def crossref(payloads: DataFrame) -> DataFrame:
    body = F.from_json("payload", "message struct<items:array<struct<title:array<string>,abstract:string,DOI:string,URL:string>>>")
    own = payloads.select("query", F.posexplode(body["message"]["items"]).alias("rank", "x"))
    title, text = F.get(F.col("x.title"), F.lit(0)), strip_tags(F.col("x.abstract"))
    return _rows(own, F.when(title.isNull(), "Untitled").otherwise(T.collapse(title)), _doi(F.coalesce("x.URL", F.lit("")), F.col("x.DOI")), text, "Crossref", text != "")


def openalex(payloads: DataFrame) -> DataFrame:
    """Abstracts come as a map from words to their positions.

    Where payloads have a page (from 1), ranks run on over a query's pages, pages after one without results
    go, and the page is returned, by which ``retrieval.gated`` decides whether it would have been asked for.
    """
    body = F.from_json("payload", "results array<struct<display_name:string,id:string,abstract_inverted_index:map<string,array<int>>>>")
    text = F.coalesce(T.inverted_abstract(F.col("x.abstract_inverted_index")), F.lit(""))
    if "page" in payloads.columns:
        pages = payloads.select("query", "page", F.coalesce(body["results"], F.array()).alias("_r"))
        past = F.coalesce(F.max((F.size("_r") == 0).cast("int")).over(Window.partitionBy("query").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hits = pages.withColumn("_past", past).where("_past = 0").select("query", "page", F.posexplode("_r").alias("_i", "x"))
        own = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("page", "_i")) - 1)
        return own.where(text != "").select("query", "rank", T.collapse(F.coalesce("x.display_name", F.lit("Untitled"))).alias("title"), F.coalesce("x.id", F.lit("")).alias("url"), text.alias("text"), F.lit("OpenAlex").alias("source"), "page")
    own = payloads.select("query", F.posexplode(body["results"]).alias("rank", "x"))
    return _rows(own, T.collapse(F.coalesce("x.display_name", F.lit("Untitled"))), F.coalesce("x.id", F.lit("")), text, "OpenAlex", text != "")


def semantic_scholar(payloads: DataFrame, least: int = 80) -> DataFrame:
    body = F.from_json("payload", "data array<struct<title:string,abstract:string,url:string,externalIds:struct<DOI:string>>>")
    own = payloads.select("query", F.posexplode(body["data"]).alias("rank", "x"))
    text = _first("abstract")
    return _rows(own, T.collapse(F.coalesce("x.title", F.lit("Untitled"))), _doi(_first("url"), F.col("x.externalIds.DOI")), text, "Semantic Scholar", F.length(text) >= least)


PAPERS = {"crossref": crossref, "openalex": openalex, "semantic_scholar": semantic_scholar}
