"""Similarities of spans: set and multiset measures, and sequence matching in Arrow batches."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import cached_property, lru_cache
from math import sqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomspan.functions import blocks as B
from loomspan.functions import lexicon as L


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def cosine_of_rows(left: DataFrame, right: DataFrame, left_key: str, right_key: str, term: str, count: str, floor: float = 0.0) -> DataFrame:
    """(left_key, right_key, cosine) for all pairs with a term in common; the others' cosine is 0.

    Both frames have a row per key and term with its count. Without a ``floor`` one join on the term and one
    partial aggregate make every such pair; terms that are very frequent on both sides are split by the
    adaptive skew join. With a floor only the pairs that may reach it are made: see ``_promising``.
    """
    norm = lambda df, key, name: df.groupBy(key).agg(F.sqrt(F.sum(F.col(count).cast("double") * F.col(count))).alias(name))
    l, r = left.select(left_key, term, F.col(count).cast("double").alias("_l")), right.select(right_key, term, F.col(count).cast("double").alias("_r"))  # noqa: E741
    norms = norm(left, left_key, "_nl"), norm(right, right_key, "_nr")
    if floor > 0:
        pairs = _promising(l.join(norms[0], left_key).select(left_key, term, (F.col("_l") / F.col("_nl")).alias("_w")), r.join(norms[1], right_key).select(right_key, term, (F.col("_r") / F.col("_nr")).alias("_w")), left_key, right_key, term, floor)
        dots = pairs.join(l, left_key).join(r, [right_key, term])
    else:
        dots = l.join(r, term)
    dots = dots.groupBy(left_key, right_key).agg(F.sum(F.col("_l") * F.col("_r")).alias("_dot"))
    out = dots.join(norms[0], left_key).join(norms[1], right_key)
    return out.select(left_key, right_key, F.least(F.lit(1.0), F.col("_dot") / (F.col("_nl") * F.col("_nr"))).alias("cosine")).where(F.col("cosine") >= floor)


def _promising(left: DataFrame, right: DataFrame, left_key: str, right_key: str, term: str, floor: float) -> DataFrame:
    """(left_key, right_key) of the pairs of unit vectors whose cosine may reach ``floor``.

    Terms are in one order, rare ones first. What a vector has from some term on adds at most its norm to
    any product, so once that is below the floor, a pair that reaches it has met before: the first term
    that both have lies in the prefix of either. Only prefixes are joined, and frequent terms are last.
    Terms that the other side lacks are left out, as they add nothing.
    """
    seen = lambda df, name: df.groupBy(term).agg(F.count("*").alias(name))
    order = seen(left, "_a").join(seen(right, "_b"), term).select(term, (F.col("_a") * F.col("_b")).alias("_n"))

    def prefix(df: DataFrame, key: str) -> DataFrame:
        rest = F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key).orderBy("_n", term).rowsBetween(0, Window.unboundedFollowing))
        return df.join(order, term).withColumn("_rest", rest).where(F.col("_rest") >= (floor - 1e-9) * (floor - 1e-9)).select(key, term)

    return prefix(left, left_key).join(prefix(right, right_key), term).select(left_key, right_key).distinct()


def _cosine(a: Counter, b: Counter) -> float:
    if len(a) > len(b):
        a, b = b, a
    dot = sum(v * b[k] for k, v in a.items() if k in b)
    if dot <= 0:
        return 0.0
    return max(0.0, min(1.0, dot / (sqrt(sum(v * v for v in a.values())) * sqrt(sum(v * v for v in b.values())))))


def _jaccard(a: frozenset, b: frozenset) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a and b else 0.0


class _Span:
    """A span's features as scoring needs them; those that only close pairs need are made when asked for."""

    def __init__(self, norm: str, content: tuple[str, ...]):
        self.norm, self.terms, self.concepts = norm, Counter(content), frozenset(content)
        self.shingles = frozenset(" ".join(content[i : i + 3]) for i in range(max(1, len(content) - 2))) if content else frozenset()

    @cached_property
    def grams(self) -> Counter:
        return Counter(self.norm[i : i + 4] for i in range(max(1, len(self.norm) - 3))) if self.norm else Counter()

    @cached_property
    def letters(self) -> Counter:
        return Counter(self.norm)


@lru_cache(20_000)
def _span(norm: str, content: tuple[str, ...]) -> _Span:
    return _Span(norm, content)


def _common(a: Counter, b: Counter) -> int:
    return (a & b).total()


def pair_parts(left: _Span, right: _Span, prior: float, floor: float) -> tuple[float, ...] | None:
    """Score and parts of a pair, or None if the score must lie below ``floor``.

    Sequence matching comes last: its ratio is at most twice the letters in common over all letters,
    and a common block of n letters holds n - 3 common 4-grams, so most pairs end at a bound. The longest
    block itself is found before the ratio, which is dearer.
    """
    token = _cosine(left.terms, right.terms)
    concept = _jaccard(left.concepts, right.concepts)
    angle = 1 - sqrt(max(0.0, 1 - token * token))
    shingle = _jaccard(left.shingles, right.shingles)
    w, p = L.SPAN_WEIGHTS, L.PAIR_WEIGHTS
    boost = 0.92 + 0.16 * max(0.0, min(1.0, prior))

    def score(sequence: float, longest: float, char: float) -> float:
        base = w["token"] * token + w["char"] * char + w["sequence"] * sequence + w["concept"] * concept + w["angle"] * angle
        return max(0.0, min(1.0, (p["span"] * max(0.0, min(1.0, base)) + p["longest"] * longest + p["shingle"] * shingle) * boost))

    if score(1.0, 1.0, 1.0) + 1e-9 < floor:
        return None
    char = _cosine(left.grams, right.grams)
    size = len(left.norm) + len(right.norm)
    most = 2.0 * _common(left.letters, right.letters) / size if size else 1.0
    block = min(1.0, (_common(left.grams, right.grams) + 3) / max(1, len(left.norm)))
    if score(most, block, char) + 1e-9 < floor:
        return None
    equal = left.norm == right.norm
    block = (len(left.norm) if equal else B.longest(left.norm, right.norm)) / max(1.0, len(left.norm))
    if score(most, block, char) + 1e-9 < floor:
        return None
    sequence = 1.0 if equal else SequenceMatcher(None, left.norm, right.norm).ratio()
    return score(sequence, block, char), token, char, sequence, concept, angle, block, shingle


def matching_ranges(left: str, right: str, least: int = 16) -> list[tuple[int, int]]:
    """Where the left text has blocks of at least so many letters in common with the right, merged."""
    if not left or not right:
        return []
    if left == right:
        return [(0, len(left))] if len(left.lower()) >= least else []
    out: list[list[int]] = []
    for a, _, n in B.matching_blocks(left.lower(), right.lower(), least):
        s, e = min(a, len(left)), min(a + n, len(left))
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        elif e > s:
            out.append([s, e])
    return [(s, e) for s, e in out]


PARTS = ["score", "token_cos", "char_cos", "sequence", "concept", "angle", "longest_ratio", "shingle"]


def scored_pairs(pairs: DataFrame, floor: float, keep: list[str]) -> DataFrame:
    """``keep`` columns with score, parts and ranges of the pairs whose score reaches ``floor``.

    ``pairs`` has l_norm, l_raw, l_content, r_norm, r_raw, r_content and prior.
    """
    kinds = [*((n, pa.float64()) for n in PARTS), ("ranges", pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("l_norm", "l_raw", "l_content", "r_norm", "r_raw", "r_content", "prior")}
            rows, found = [], []
            for i in range(b.num_rows):
                parts = pair_parts(_span(c["l_norm"][i], tuple(c["l_content"][i])), _span(c["r_norm"][i], tuple(c["r_content"][i])), c["prior"][i], floor)
                if parts is not None and parts[0] >= floor:
                    rows.append(i)
                    found.append((*parts, [{"s": s, "e": e} for s, e in matching_ranges(c["l_raw"][i], c["r_raw"][i])]))
            kept = b.select(keep).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([f[k] for f in found], t) for k, (_, t) in enumerate(kinds))], names=[*keep, *(n for n, _ in kinds)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.select(*keep).schema), *(f"{n} double" for n in PARTS), "ranges array<struct<s:int,e:int>>"])
    # scoring is the costly part, so pairs are dealt out evenly whatever the joins before have left
    return pairs.repartition(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, schema)


def sequence_ratio(left: Column, right: Column, autojunk: bool = False) -> Column:
    """Ratcliff-Obershelp ratio; the order of the two matters. With ``autojunk``, frequent letters of long texts count less."""
    of = (lambda x, y: SequenceMatcher(None, x, y).ratio()) if autojunk else B.ratio

    @F.pandas_udf(DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([of(x, y) for x, y in zip(a, b, strict=True)])

    return ratio(left, right)
