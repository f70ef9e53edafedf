"""Word chunks and the reduction of long pairs of texts to their most alike chunks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from math import sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions import lexicon as L
from loomspan.functions import plain as Y
from loomspan.functions import text as T
from loomspan.operators.spans import pinned

WORDS, STRIDE, MOST, PICKED, LONG = 260, 190, 180, 14, 5500
LEAST = 0.12


def words(c: Column) -> Column:
    t = T.collapse(c)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def word_chunks(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = WORDS, stride: int = STRIDE, most: int = MOST) -> DataFrame:
    """key, chunk, start, end (in words), text, tokens: overlapping chunks, the last one reaching the end."""
    own = pinned(df.select(key, F.col(text).alias("_t")), _w=words(F.col("_t"))).drop("_t")
    own = pinned(own, _n=F.size("_w")).where("_n > 0")
    heads = F.filter(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(stride)), lambda i: (i == 0) | (i - stride + size < F.col("_n")))
    cut = own.select(key, "_w", "_n", F.posexplode(F.slice(heads, 1, most)).alias("chunk", "start"))
    end = F.least(F.col("start") + size, F.col("_n"))
    out = cut.select(key, "chunk", "start", end.alias("end"), F.array_join(F.slice("_w", F.col("start") + 1, end - F.col("start")), " ").alias("text"))
    return pinned(out, tokens=T.chunk_token_set(F.col("text")))


def anchors(n: Column) -> Column:
    """Chunks that are kept in any case: ends and middle, and the quarters of more than four."""
    base = F.array(F.lit(0), F.floor(n / 2).cast("int"), n - 1)
    more = F.array(F.floor(n / 4).cast("int"), F.floor(3 * n / 4).cast("int"))
    return F.array_sort(F.array_distinct(F.when(n > 4, F.concat(base, more)).otherwise(base)))


def chunk_pairs(research: DataFrame, reference: DataFrame, key: str = "pair_id", least: float = LEAST) -> DataFrame:
    """key, research_chunk, reference_chunk, score: the most alike reference chunk of each research chunk.

    A score is the number of shared terms over the root of both sizes' product; ties go to the earlier
    reference chunk.
    """
    a = research.select(key, F.col("chunk").alias("research_chunk"), F.size("tokens").alias("_a"), F.explode("tokens").alias("_t"))
    b = reference.select(key, F.col("chunk").alias("reference_chunk"), F.size("tokens").alias("_b"), F.explode("tokens").alias("_t"))
    hits = a.join(b, [key, "_t"]).groupBy(key, "research_chunk", "reference_chunk", "_a", "_b").agg(F.count("*").alias("hits"))
    scored = hits.withColumn("score", F.col("hits") / F.sqrt(F.col("_a") * F.greatest(F.lit(1), F.col("_b"))))
    rank = F.row_number().over(Window.partitionBy(key, "research_chunk").orderBy(F.desc("hits"), "reference_chunk"))
    return scored.withColumn("_r", rank).where((F.col("_r") == 1) & (F.col("score") >= least)).select(key, "research_chunk", "reference_chunk", "score")


def selected(chunks: DataFrame, pairs: DataFrame, side: str, key: str = "pair_id", most: int = PICKED) -> DataFrame:
    """key, chunk of the chunks of one side that are kept: anchors, then the best pairs' up to ``most``."""
    count = chunks.groupBy(key).agg(F.count("*").cast("int").alias("_n"))
    fixed = count.select(key, F.explode(F.slice(anchors(F.col("_n")), 1, most)).alias("chunk"))
    order = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "research_chunk"))
    ranked = pairs.withColumn("_o", order).groupBy(key, F.col(side).alias("chunk")).agg(F.min("_o").alias("_o")).join(fixed, [key, "chunk"], "left_anti")
    room = fixed.groupBy(key).agg((F.lit(most) - F.count("*")).alias("_room"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("_o"))
    more = ranked.withColumn("_p", place).join(room, key).where(F.col("_p") <= F.col("_room")).select(key, "chunk")
    return fixed.unionByName(more)


def joined(chunks: DataFrame, kept: DataFrame, key: str = "pair_id", budget: int = 5200) -> DataFrame:
    """key, text, words, used: kept chunks in order, parted by blank lines, within a budget of words."""
    own = chunks.join(kept, [key, "chunk"]).withColumn("_n", F.col("end") - F.col("start"))
    w = Window.partitionBy(key).orderBy("chunk")
    own = own.withColumn("_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where(F.col("_before") < budget)
    own = own.withColumn("_t", F.array_join(F.slice(F.split("text", " "), F.lit(1), F.least(F.col("_n"), F.lit(budget) - F.col("_before")).cast("int")), " "))
    out = own.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("chunk", "_t"))).alias("_l"), F.count("*").alias("used"))
    return out.select(key, F.array_join(F.transform("_l", lambda x: x["_t"]), "\n\n").alias("text"), "used")


_STOP = frozenset(L.CHUNK_STOPWORDS)


def chunks_of(words: list[str], most: int | None = MOST) -> list[tuple[int, int]]:
    """Begin and end of the chunks of one text, as ``word_chunks`` cuts them; of the whole text where ``most`` is None."""
    n = len(words)
    return [(i, min(i + WORDS, n)) for i in range(0, n, STRIDE) if i == 0 or i - STRIDE + WORDS < n][:most]


def token_sets(words: list[str], cut: list[tuple[int, int]]) -> list[set[str]]:
    return [{t for t in Y.tokens(" ".join(words[a:z])) if len(t) >= 4 and not t.isdecimal() and t not in _STOP} for a, z in cut]


def pairs_of(research: list[set[str]], reference: list[set[str]], least: float = LEAST) -> list[tuple[int, int, float]]:
    """The same as ``chunk_pairs`` for the chunks of one pair of texts."""
    places: dict[str, list[int]] = {}
    for j, terms in enumerate(reference):
        for t in terms:
            places.setdefault(t, []).append(j)
    out = []
    for i, terms in enumerate(research):
        hits = Counter(j for t in terms for j in places.get(t, ()))
        if hits:
            j, n = min(hits.items(), key=lambda x: (-x[1], x[0]))
            if (score := n / sqrt(len(terms) * max(1, len(reference[j])))) >= least:
                out.append((i, j, score))
    return out


def kept_of(n: int, pairs: list[tuple[int, int, float]], side: int, most: int = PICKED) -> list[int]:
    """The same as ``selected`` for one text of ``n`` chunks."""
    fixed = sorted({0, n // 2, n - 1} | ({n // 4, 3 * n // 4} if n > 4 else set()))[:most]
    ranked = dict.fromkeys(p[side] for p in sorted(pairs, key=lambda p: (-p[2], p[0])))
    return sorted(fixed + [c for c in ranked if c not in fixed][: most - len(fixed)])


def joined_of(words: list[str], cut: list[tuple[int, int]], kept: list[int], budget: int = 5200) -> tuple[str, int]:
    """The same as ``joined`` for one text."""
    out, before = [], 0
    for c in kept:
        if before >= budget:
            break
        a, z = cut[c]
        out.append(" ".join(words[a : min(z, a + budget - before)]))
        before += z - a
    return "\n\n".join(out), len(out)


def _row_wise(df: DataFrame, columns: list[str], made: Callable[[str | None, str | None], list[tuple]], names: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """The rows that ``made`` gives for (text, reference text), each with the first column; nothing is exchanged."""
    own = df.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, 64):
                b = whole.slice(a, 64)
                found = [(i, r) for i, x in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)) for r in made(*x)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in found], pa.int64())), *(pa.array([r[k] for _, r in found], kind) for k, (_, kind, _) in enumerate(names))], names=[columns[0], *(n for n, _, _ in names)])

    return own.mapInArrow(run, f"`{columns[0]}` {own.schema[columns[0]].dataType.simpleString()}, " + ", ".join(f"`{n}` {t}" for n, _, t in names))


def text_pairs(df: DataFrame, key: str = "pair_id", reference: str = "reference_text", text: str = "text") -> DataFrame:
    """``chunk_pairs`` of the texts of each row, however long: both lie there, so their chunks meet there, too."""

    def made(t: str | None, r: str | None) -> list[tuple]:
        a, b = (t or "").split(), (r or "").split()
        return pairs_of(token_sets(a, chunks_of(a, None)), token_sets(b, chunks_of(b, None)))

    return _row_wise(df, [key, text, reference], made, [("research_chunk", pa.int32(), "int"), ("reference_chunk", pa.int32(), "int"), ("score", pa.float64(), "double")])


def reduce_pairs(df: DataFrame, key: str = "pair_id", reference: str = "reference_text", text: str = "text", long: int = LONG) -> DataFrame:
    """key, reference_text, text, used_chunking, and counts: pairs with a long text reduced to alike chunks.

    Chunks of the whole texts are compared, however many. Both texts lie in one row and are cut, compared and joined there, so chunks are neither written nor exchanged.
    """

    def made(t: str | None, r: str | None) -> list[tuple]:
        a, b = (t or "").split(), (r or "").split()
        if max(len(a), len(b)) < long or not a or not b:
            return [(r, t, False, len(b), len(a), 0, 0, 0, 0, len(b), len(a))]
        x, y = chunks_of(a, None), chunks_of(b, None)
        pairs = pairs_of(token_sets(a, x), token_sets(b, y))
        (left, used), (right, other) = joined_of(a, x, kept_of(len(x), pairs, 0)), joined_of(b, y, kept_of(len(y), pairs, 1))
        return [(right, left, True, len(b), len(a), len(y), len(x), other, used, len(right.split()), len(left.split()))]

    numbers = ["reference_words", "research_words", "reference_chunks", "research_chunks", "reference_used", "research_used", "reference_words_used", "research_words_used"]
    return _row_wise(df, [key, text, reference], made, [("reference_text", pa.string(), "string"), ("text", pa.string(), "string"), ("used_chunking", pa.bool_(), "boolean"), *((n, pa.int64(), "bigint") for n in numbers)])


def analysis_text(c: Column, most: int = 2400) -> Column:
    """Three distinct segments of a long text's words, parted by blank lines; shorter texts collapsed."""
    w = words(c)
    n, seg = F.size(w), max(500, most // 3)
    middle = F.greatest(F.floor(n / 2).cast("int") - seg // 2, F.lit(0))
    parts = F.array_distinct(F.array(*[F.array_join(x, " ") for x in (F.slice(w, 1, seg), F.slice(w, middle + 1, F.lit(seg)), F.slice(w, F.greatest(n - seg, F.lit(0)) + 1, F.lit(seg)))]))
    return F.when(n <= most, F.array_join(w, " ")).otherwise(F.array_join(parts, "\n\n"))
