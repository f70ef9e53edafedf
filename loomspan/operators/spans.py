"""Spans: paragraphs, sentence windows and sentences of a text, with offsets and features.

Each text is cut within its row, in Arrow batches: offsets follow from the matches themselves, and
nothing is exchanged. (As column expressions the same took minutes where this takes seconds, because a
lambda evaluates what it refers to anew for each element.)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import lexicon as L
from loomspan.functions import plain as Y
from loomspan.functions.html import pinned  # noqa: F401

#: Tokens above which a paragraph is cut into windows of sentences; their size, distance and, where
#: only so many are asked for, number.
LARGE, SIZE, STRIDE, MOST = 170, 4, 2, 180
Found = tuple[int, str, int, int, str, list[str]]  # span_id, kind, start, end, raw, tokens
_LISTS = pa.list_(pa.string())
_COLUMNS = [("span_id", pa.int32(), "int"), ("kind", pa.string(), "string"), ("start", pa.int32(), "int"), ("end", pa.int32(), "int"), ("raw", pa.string(), "string"), ("tokens", _LISTS, "array<string>"), ("norm", pa.string(), "string")]
_FEATURES = [("content", _LISTS, "array<string>"), ("concepts", _LISTS, "array<string>"), ("shingles", _LISTS, "array<string>"), ("counts", pa.list_(pa.int32()), "array<int>"), ("reach", pa.int32(), "int")]




def sentences_of(text: str, least: int) -> list[Found]:
    """Sentences of enough words; the number is the place among all matches."""
    out = []
    for i, m in enumerate(Y.SENTENCE.finditer(text)):
        raw = Y.collapse(m.group())
        toks = Y.tokens(raw)
        if raw and len(toks) >= least:
            out.append((i, "sentence", m.start(), m.end(), raw, toks))
    return out


def windows_of(block: str, offset: int, least: int, most: int | None = MOST) -> list[tuple[str, int, int, str, list[str]]]:
    """Windows of four sentences, two apart, until one reaches the end; none for fewer than three sentences."""
    places = [m.span() for m in Y.SENTENCE.finditer(block) if m.group().strip()]
    out = []
    if len(places) >= 3:
        for i in range(0, len(places), STRIDE):
            if i and i + STRIDE >= len(places):  # the one before reached the last sentence
                break
            a, z = places[i][0], places[min(i + SIZE, len(places)) - 1][1]
            raw = Y.collapse(block[a:z])
            toks = Y.tokens(raw)
            if len(toks) >= least:
                out.append(("window", offset + a, offset + z, raw, toks))
    return out[:most]


def paragraphs_of(text: str, least: int, most: int | None = MOST) -> list[Found]:
    """Paragraphs of enough words, large ones as their windows if they have any, all of them where ``most`` is None."""
    out: list[tuple[str, int, int, str, list[str]]] = []
    for m in Y.PARAGRAPH.finditer(text):
        raw = Y.collapse(m.group())
        toks = Y.tokens(raw)
        if raw and len(toks) >= least:
            cut = windows_of(m.group(), m.start(), least, most) if len(toks) > LARGE else []
            out += cut or [("paragraph", m.start(), m.end(), raw, toks)]
    return [(i, *x) for i, x in enumerate(out)]


def _spans(df: DataFrame, key: str, text: str, cut: Callable[[str], list[Found]], featured: bool) -> DataFrame:
    own = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    columns = _COLUMNS + (_FEATURES if featured else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                b = whole.slice(a, 256)
                at, rows = [], []
                for i, t in enumerate(b.column(1).to_pylist()):
                    for s in cut(t):
                        at.append(i)
                        row = (*s, " ".join(s[5]))
                        if featured:
                            c = Y.content(s[5])
                            row = (*row, c, Y.distinct(c), Y.shingles(c), Y.counts(c), Y.reach(s[5]))
                        rows.append(row)
                made = [pa.array([r[k] for r in rows], kind) for k, (_, kind, _) in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *made], names=["doc_id", *(n for n, _, _ in columns)])

    return own.mapInArrow(run, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"`{n}` {t}" for n, _, t in columns))


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 3, featured: bool = False) -> DataFrame:
    """doc_id, span_id, kind, start, end, raw, tokens, norm of sentences; span_id ascends with the place."""
    return _spans(df, key, text, lambda t: sentences_of(t, min_words), featured)


def paragraphs(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 6, featured: bool = False) -> DataFrame:
    """The same of paragraphs, large ones cut into windows."""
    return _spans(df, key, text, lambda t: paragraphs_of(t, min_words), featured)


def spans(df: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 6, sentence_words: int = 3, featured: bool = False) -> DataFrame:
    """Paragraphs, or sentences for the texts that have none: of the whole text, however many.

    ``featured`` adds content (canonical terms), concepts (distinct ones) with their counts, shingles of three
    terms, and reach, the longest stretch with fewer than three whole terms.
    """
    return _spans(df, key, text, lambda t: paragraphs_of(t, min_words, None) or sentences_of(t, sentence_words), featured)


def blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, i, block: all paragraphs as they stand."""
    own = df.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    return own.select(key, F.posexplode(F.regexp_extract_all("_text", F.lit(L.PARAGRAPH.replace(r"\s", L.SPACE)), F.lit(0))).alias("i", "block"))


def paragraph_ids(sents: DataFrame, paras: DataFrame) -> DataFrame:
    """The first paragraph that each sentence begins in, or -1.

    One sorted sweep per document, backwards over the sentences' beginnings and the paragraphs' ends: as
    later paragraphs (and windows) end no earlier, the last end met belongs to the first paragraph that
    is not over yet, and the sentence lies in it if it has begun. Ids must tell documents apart.
    """
    none = F.lit(None).cast("struct<id:int,start:int>")
    points = sents.select("doc_id", "span_id", F.col("start").alias("_at"), F.lit(0).alias("_end"), F.lit(0).alias("_id"), none.alias("_p"))
    ends = paras.select("doc_id", F.lit(None).cast("int").alias("span_id"), F.col("end").alias("_at"), F.lit(1).alias("_end"), F.col("span_id").alias("_id"), F.struct(F.col("span_id").alias("id"), "start").alias("_p"))
    back = Window.partitionBy("doc_id").orderBy(F.desc("_at"), "_end", F.desc("_id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = points.unionByName(ends).withColumn("_p", F.last("_p", ignorenulls=True).over(back)).where("_end = 0")
    return swept.select("doc_id", "span_id", F.when(F.col("_p.start") <= F.col("_at"), F.col("_p.id")).otherwise(-1).alias("paragraph_id"))
