"""Text out of HTML pages as column expressions; only entities go through Python functions.

These get rows in batches of a hundred, not as Arrow columns: those hold 10,000 pages at once, so that a
worker's memory grows with the table until they are full.
"""

from __future__ import annotations

import html as entities

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from loomspan.functions import lexicon as L
from loomspan.functions.text import collapse, distributed_sample, file_name, is_pdf


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns computed once per row, however often lambdas refer to them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


# Patterns of elements that hold no main text, of those that may, of the marks that count
# in these, and of JSON values that may be a body.
SILENT = r"(?is)<(script|style|noscript|svg|header|footer|nav|aside)[^>]*>.*?</\1>"
MARKED = r"[^>]+(?:id|class)=['\"][^'\"]*(?:article|content|main|post|entry|story|body)[^'\"]*['\"][^>]*>"
BLOCKS = [r"(?is)<article[^>]*>(.*?)</article>", r"(?is)<main[^>]*>(.*?)</main>", rf"(?is)<section{MARKED}(.*?)</section>", rf"(?is)<div{MARKED}(.*?)</div>"]
PARAGRAPH, HEADING = r"(?i)<p\b", r"(?i)<h[1-3]\b"
SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"
BODIES = [r'(?is)"articleBody"\s*:\s*"((?:\\.|[^"\\])++)"', r'(?is)"text"\s*:\s*"((?:\\.|[^"\\])++)"']
BODY_MARKS = ["articleBody", '"text"']
LEAST = 320


@F.udf(StringType(), useArrow=False)
def unescape(s: str | None) -> str | None:
    return entities.unescape(s) if s and "&" in s else s


@F.udf(ArrayType(StringType()), useArrow=False)
def json_bodies(values: list[str]) -> list[str]:
    """JSON string values of a page, escapes resolved, bytes read as Latin-1, entities resolved.

    Escapes that do not read are left out; halves of a pair are joined, a single half reads as U+FFFD.
    """

    def read(v: str) -> str:
        text = entities.unescape(v.encode("utf-8").decode("unicode_escape", "ignore"))
        return text.encode("utf-16-le", "surrogatepass").decode("utf-16-le", "replace")

    return [read(v) for v in values]


def strip_tags(c: Column) -> Column:
    """Tags as blanks, entities resolved, white space collapsed."""
    return collapse(unescape(F.regexp_replace(F.coalesce(c, F.lit("")), L.TAG, " ")))


def strip_tags_plain(c: Column) -> Column:
    """The same without resolving entities, all in the JVM."""
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), L.TAG, " "))


def title(c: Column, most: int = 200) -> Column:
    return F.substring(strip_tags(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)), 1, most)


def without_boilerplate(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), SILENT, " ")


def blocks(c: Column) -> Column:
    """Inner HTML of the elements that may hold the main text, in the order of the patterns."""
    return F.flatten(F.array(*[F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in BLOCKS]))


def script_bodies(c: Column) -> Column:
    """JSON values that may be the main text, script by script."""
    scripts = F.filter(F.regexp_extract_all(c, F.lit(SCRIPT), F.lit(1)), lambda x: F.contains(x, F.lit(BODY_MARKS[0])) | F.contains(x, F.lit(BODY_MARKS[1])))
    return F.flatten(F.transform(scripts, lambda x: F.concat(*[F.regexp_extract_all(x, F.lit(p), F.lit(1)) for p in BODIES])))


def main_text(df: DataFrame, html: str, out: str = "main_text") -> DataFrame:
    """Adds the page's main text: the best scored element or JSON body, else the whole page's text.

    An element scores its text's length, 220 for each paragraph and 120 for each heading in it; a JSON
    body its length and 800. Only texts of 320 characters or more count, and the first best wins.
    """
    raw = F.coalesce(F.col(html), F.lit(""))
    df = pinned(pinned(df, _clean=without_boilerplate(raw)), _blocks=blocks(F.col("_clean")))
    df = df.withColumn("_json", json_bodies(script_bodies(raw)))
    # entities of all elements are resolved in one pass, as one text parted by a character HTML cannot hold
    parts = F.concat(F.transform("_blocks", lambda b: F.regexp_replace(b, L.TAG, " ")), F.array(F.regexp_replace("_clean", L.TAG, " ")))
    df = df.withColumn("_all", F.split(unescape(F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\x00"), F.lit("\ufffd"))), "\x00")), "\x00"))
    n = F.size("_blocks")
    df = pinned(df, _texts=F.transform(F.concat(F.slice("_all", F.lit(1), n), F.col("_json"), F.slice("_all", -1, 1)), collapse)).drop("_all")

    def scored(text: Column, i: Column) -> Column:
        block = F.get(F.col("_blocks"), i)
        own = F.length(text) + 220 * F.regexp_count(block, F.lit(PARAGRAPH)) + 120 * F.regexp_count(block, F.lit(HEADING))
        return F.struct(F.when(i < n, own).otherwise(F.length(text) + 800).alias("score"), (-i).alias("i"), text.alias("text"))

    best = F.array_max(F.filter(F.transform(F.slice("_texts", F.lit(1), F.size("_texts") - 1), scored), lambda x: F.length(x["text"]) >= LEAST))
    return df.withColumn(out, F.coalesce(best["text"], F.element_at("_texts", -1))).drop("_clean", "_blocks", "_json", "_texts")


def reference_from_page(pages: DataFrame, url: str = "url", html: str = "html", most: int = 26_000, least: int = 180, pdf: str | None = None, content_type: str | None = None) -> DataFrame:
    """ref_id is not set here: url, title, text, source and status of directly imported pages.

    ``pdf`` is the column with the text of pages that are PDF files, by their address or content type;
    these are named by their file. Pages without enough text have a status that says so.
    """
    kind = is_pdf(F.col(url), F.col(content_type) if content_type else None)
    own = main_text(pages.withColumn("_pdf", kind), html, "_text")
    of_pdf = F.substring(F.coalesce(F.col(pdf) if pdf else F.lit(None).cast("string"), F.lit("")), 1, 30_000)
    text = F.when(F.col("_pdf"), of_pdf).otherwise(distributed_sample(F.col("_text"), most))
    found = F.length(text) >= least
    name = title(F.col(html))
    named = F.when(F.col("_pdf"), file_name(F.col(url))).when(name == "", F.col(url)).otherwise(name)
    status = F.when(found, "ok").when(F.col("_pdf"), "too little text in the PDF").otherwise("too little text")
    return own.select(F.col(url).alias("url"), named.alias("title"), F.when(found, text).alias("text"), F.lit("URL Import").alias("source"), status.alias("status"))


def readable_pages(pages: DataFrame, url: str = "url", html: str = "html", most: int = 22_000, pdf: str | None = None, content_type: str | None = None) -> DataFrame:
    """url, page_title, page_text as page expansion reads them: empty below 200 letters of HTML or 260 of text.

    ``pdf`` is the column with the text of pages that are PDF files, by their address or content type; these
    are named by their file and have neither name nor text below 260 letters.
    """
    kind = is_pdf(F.col(url), F.col(content_type) if content_type else None) if pdf else F.lit(False)
    own = main_text(pages.where(F.lower(F.col(url)).rlike("^https?://")).withColumn("_pdf", F.coalesce(kind, F.lit(False))), html, "_text")
    there = F.length(F.coalesce(F.col(html), F.lit(""))) >= 200
    text = distributed_sample(F.col("_text"), most)
    of_pdf = F.coalesce(F.col(pdf) if pdf else F.lit(None).cast("string"), F.lit(""))
    read = F.length(of_pdf) >= 260
    name = F.when(F.col("_pdf"), F.when(read, file_name(F.col(url))).otherwise("")).when(there, title(F.col(html))).otherwise("")
    page = F.when(F.col("_pdf"), F.when(read, of_pdf).otherwise("")).when(there & (F.length(text) >= 260), text).otherwise("")
    return own.select(F.col(url).alias("url"), name.alias("page_title"), page.alias("page_text"))


