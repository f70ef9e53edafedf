"""Text out of files: plain text, word processor documents and PDF pages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import plain as Y
from loomspan.functions import text as T
from loomspan.functions.html import readable_pages
from loomspan.session import settled

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(content: bytes) -> str:
    """The paragraphs that stand directly in a document's body, a line each; empty if it does not read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    marks = {f"{_W}tab": "\t", f"{_W}br": "\n", f"{_W}cr": "\n"}
    return "\n".join("".join(x.text or "" if x.tag == f"{_W}t" else marks.get(x.tag, "") for x in p.iter()) for p in (body if body is not None else ()) if p.tag == f"{_W}p")


def pdf_pages(content: bytes) -> list[str]:
    """The pages' texts by whichever PDF library is installed."""
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("reading PDF files needs a PDF library such as pypdf, or an extractor of your own") from e
    return [p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages]


def read_files(spark: SparkSession, path: str, pdf: Callable[[bytes], list[str]] = pdf_pages, second: Callable[[bytes], list[str]] | None = None) -> DataFrame:
    """path, text of the .txt, .docx and .pdf files at ``path``; other files, and broken ones, are empty.

    Suffixes count in lower case only. Bytes that are no UTF-8 are left out. A PDF file of which ``pdf``
    makes fewer than 120 letters is read by ``second``, another extractor, if there is one.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return clean(texts(files, pdf, second))


def texts(files: DataFrame, pdf: Callable[[bytes], list[str]] = pdf_pages, second: Callable[[bytes], list[str]] | None = None, least: int = 120) -> DataFrame:
    """path, text as extracted from (path, content)."""

    def pdf_text(content: bytes) -> str:
        text = "\n".join(pdf(content))
        return "\n".join(second(content)) if second is not None and len(" ".join(text.split())) < least else text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def read(path: str, content: bytes) -> str:
            if path.endswith(".txt"):
                return content.decode("utf-8", "ignore")
            if path.endswith(".docx"):
                return docx_text(content)
            return pdf_text(content) if path.endswith(".pdf") else ""

        for b in batches:
            yield pd.DataFrame({"path": b.path, "text": [read(p, c) for p, c in zip(b.path, b.content, strict=True)]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def clean(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, T.strip(T.cleaned(F.col(text))))


def page_lines(boxes: DataFrame, keys: tuple[str, ...] = ("doc_id", "page"), gap: float = 2.2, plain: DataFrame | None = None, least: int = 20) -> DataFrame:
    """keys, text: a page's words in lines. ``boxes`` has the keys, x0, y0, word.

    ``plain`` (keys, text) is the pages' own text, taken where the words make fewer than ``least`` letters.

    Words go by height and place; a line ends where a word lies ``gap`` below or above the line's
    height, which follows its words by three tenths each.
    """
    own = boxes.where(T.strip(F.col("word")) != "").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.bround("y0", 1).alias("y"), F.col("x0").alias("x"), F.col("y0").alias("h"), F.col("word").alias("w")))).alias("_b"))
    none = F.struct(F.lit(None).cast("double").alias("h"), F.lit("").alias("t"))

    def add(s: Column, b: Column) -> Column:
        new = F.abs(b["h"] - s["h"]) > gap
        return F.when(s["h"].isNull(), F.struct(b["h"].alias("h"), b["w"].alias("t"))).when(new, F.struct(b["h"].alias("h"), F.concat(s["t"], F.lit("\n"), b["w"]).alias("t"))).otherwise(F.struct((0.7 * s["h"] + 0.3 * b["h"]).alias("h"), F.concat(s["t"], F.lit(" "), b["w"]).alias("t")))

    made = own.select(*keys, F.aggregate("_b", none, add)["t"].alias("text"))
    if plain is None:
        return made
    both = made.withColumnRenamed("text", "_made").join(plain.select(*keys, "text"), [*keys], "full")
    return both.select(*keys, F.when(F.length(T.strip(F.col("_made"))) >= least, T.strip(F.col("_made"))).otherwise(F.coalesce("text", F.lit(""))).alias("text"))


Reader = Callable[[bytes], tuple[int, Callable[[int], str]]]


def pdf_reader(content: bytes) -> tuple[int, Callable[[int], str]]:
    """The number of pages and a function that extracts one, by whichever PDF library is installed."""
    try:
        import pypdf
    except ImportError as e:
        raise RuntimeError("reading PDF files needs a PDF library such as pypdf, or a reader of your own") from e
    pages = pypdf.PdfReader(io.BytesIO(content)).pages
    return len(pages), lambda i: pages[i].extract_text() or ""


def read_pages(payloads: DataFrame, reader: Reader = pdf_reader, most_pages: int = 40, most_chars: int = 22_000, least: int = 20) -> DataFrame:
    """doc_id, n_pages, page (from 0), text of PDF payloads (doc_id, content): a row for each sampled page.

    Pages are extracted one at a time and handed on as they come, never a file as a whole; a file is left
    as soon as its pages of ``least`` letters or more, cleaned, have ``most_chars`` together. So a long
    file costs what its caps allow. A payload that is null, empty or that the reader refuses has no rows;
    a page that it refuses is left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                content = b.column(1)[i].as_py()
                try:
                    total, page = reader(content) if content else (0, str)
                except RuntimeError:
                    raise
                except Exception:
                    continue
                held = 0
                for k in Y.sample_indexes(total, most_pages):
                    if held >= most_chars:
                        break
                    try:
                        text = page(k)
                    except Exception:
                        continue
                    n = len(Y.clean_block(text))
                    held += n if n >= least else 0
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), pa.array([total], pa.int32()), pa.array([k], pa.int32()), pa.array([text])], names=["doc_id", "n_pages", "page", "text"])

    own = payloads.select("doc_id", F.col("content").cast("binary"))
    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_pages int, page int, text string")


def pdf_texts(payloads: DataFrame, first: Reader = pdf_reader, second: Reader | None = None, enough: int = 180, most_pages: int = 40, most_chars: int = 22_000, least: int = 20) -> DataFrame:
    """doc_id, text of PDF payloads (doc_id, content), "" where nothing was read.

    Those of which ``first`` makes fewer than ``enough`` letters are read by ``second``, if there is one,
    under the same caps. Ids must tell payloads apart.
    """
    read = lambda rows, reader: pages_text(read_pages(rows, reader, most_pages, most_chars, least), most_pages, most_chars, least)
    out = payloads.select("doc_id").join(read(payloads, first), "doc_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
    if second is None:
        return out
    out = settled(out)
    short = F.length(T.collapse(F.col("text"))) < enough
    again = read(payloads.join(out.where(short).select("doc_id"), "doc_id", "left_semi"), second).withColumnRenamed("text", "_again")
    return out.join(again, "doc_id", "left").select("doc_id", F.when(short, F.coalesce("_again", F.lit(""))).otherwise(F.col("text")).alias("text"))


def readable(pages: DataFrame, first: Reader = pdf_reader, second: Reader | None = None, most: int = 22_000) -> DataFrame:
    """url, page_title, page_text of fetched pages (url, content_type, html, content: bytes), PDF files among them.

    PDF files are read from ``content``, up to 80 pages and 52,000 letters; one row per address.
    """
    kind = F.coalesce(T.is_pdf(F.col("url"), F.col("content_type")), F.lit(False))
    payloads = pages.where(kind).groupBy("url").agg(F.min("content").alias("content")).withColumnRenamed("url", "doc_id")
    read = pdf_texts(payloads, first, second, most_pages=80, most_chars=max(most, 52_000)).select(F.col("doc_id").alias("url"), F.col("text").alias("_of_pdf"))
    own = pages.select("url", "content_type", "html").dropDuplicates(["url"]).join(read, "url", "left")
    return readable_pages(own, most=most, pdf="_of_pdf", content_type="content_type")


def pages_text(pages: DataFrame, most_pages: int = 40, most_chars: int = 22_000, least: int = 20) -> DataFrame:
    """doc_id, text of sampled pages: cleaned, short ones dropped, cut where the letters run out.

    ``pages`` has doc_id, page (from 0), text; the page that exceeds ``most_chars`` is cut, later ones go.
    Where it has n_pages, that is the number of a document's pages; else the last page in it tells.
    """
    total = F.col("n_pages") if "n_pages" in pages.columns else F.max("page").over(Window.partitionBy("doc_id")) + 1
    own = pages.withColumn("_n", total).where(F.array_contains(T.sample_indexes(F.col("_n").cast("int"), F.lit(most_pages)), F.col("page").cast("int")))
    own = own.withColumn("_t", T.clean_block(F.col("text"))).where(F.length("_t") >= least)
    before = F.coalesce(F.sum(F.length("_t")).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = own.withColumn("_before", before).where(F.col("_before") < most_chars)
    own = own.withColumn("_t", F.substring("_t", F.lit(1), (F.lit(most_chars) - F.col("_before")).cast("int")))
    out = own.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "_t"))), lambda x: x["_t"]), "\n\n").alias("_t"))
    return out.select("doc_id", T.strip(T.repair_spaced(T.clean_block(F.col("_t")))).alias("text"))
