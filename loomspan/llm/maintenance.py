"""Aggregates by group, kept up to date batch by batch from entries and exits.

A row is present from the batch it begins in until the batch it ends in. Counts and sums follow from
prefix sums over batches; the number of distinct items from each item's lifetimes merged. Order statistics
come from two wavelet matrices of a group, one of the values that entered and one of those that left, both
in order of time: the k-th value present after a batch is found by descending both at once by the
difference of their prefix counts, so any rank of any batch is read from the same two matrices and nothing
is kept sorted.

Rows with the same group, value and batch are one element with weights before they move, so a value that is
on very many rows is one element a batch. Matrices of up to ``STRETCH`` elements lie in one task whole. Of
a larger group the upper levels are a table of nodes (four bits of the value a step) with each node's prefix
count differences by batch; Spark joins and windows descend through it, every step over 16 nodes at most,
until a stretch of the matrices remains that is small or 16 values wide.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import shared_checkpoint, table

STRETCH = 256
STEP = 4  # bits of a value that one step of the distributed descent settles


class WaveletMatrix:
    """Weighted codes in order of time; counts of any prefix are led through the levels of the codes' bits."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bits: int):
        self.levels = []  # from the highest bit: zeros before each place, their weights, zeros in all
        for bit in range(bits - 1, -1, -1):
            zero = (codes >> bit & 1) == 0
            before = np.concatenate([[0], np.cumsum(zero)])
            weight = np.concatenate([[0], np.cumsum(np.where(zero, weights, 0))])
            self.levels.append((before, weight, int(before[-1])))
            order = np.argsort(~zero, kind="stable")
            codes, weights = codes[order], weights[order]

    def zeros(self, level: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Weight of the elements with a zero bit among the places from begin to end."""
        weight = self.levels[level][1]
        return weight[end] - weight[begin]

    def down(self, level: int, place: np.ndarray, one: np.ndarray) -> np.ndarray:
        """Where a place of this level lies on the next one, on the side that was chosen."""
        before, _, zeros = self.levels[level]
        return np.where(one, zeros + place - before[place], before[place])


def select(entries: tuple[WaveletMatrix, np.ndarray], exits: tuple[WaveletMatrix, np.ndarray], bits: int, k: np.ndarray) -> np.ndarray:
    """Codes of the elements of rank k, from 0, among what has entered and not left.

    Beside each matrix stands the length of the prefix that each rank is asked of.
    """
    k, code = k.copy(), np.zeros(len(k), np.int64)
    sides = [[m, np.zeros(len(k), np.int64), end] for m, end in (entries, exits)]
    for level in range(bits):
        zeros = sides[0][0].zeros(level, *sides[0][1:]) - sides[1][0].zeros(level, *sides[1][1:])
        one = k >= zeros
        k = np.where(one, k - zeros, k)
        code = code << 1 | one
        for side in sides:
            side[1], side[2] = side[0].down(level, side[1], one), side[0].down(level, side[2], one)
    return code


def _stretch(elements: pd.DataFrame, asked: pd.DataFrame) -> np.ndarray:
    """Values of the asked ranks in one stretch; elements have value, batch, entered, left."""
    elements = elements.sort_values("batch", kind="stable")
    values, codes = np.unique(elements["value"].to_numpy(), return_inverse=True)
    bits = int(len(values) - 1).bit_length()
    sides = []
    for weight in ("entered", "left"):
        there = elements[weight].to_numpy() > 0
        batches = elements["batch"].to_numpy()[there]
        matrix = WaveletMatrix(codes[there], elements[weight].to_numpy()[there], bits)
        sides.append((matrix, np.searchsorted(batches, asked["batch"].to_numpy(), side="right")))
    return values[select(*sides, bits, asked["k"].to_numpy())]


def elements_of(lives: DataFrame, groups: list[str], batches: int) -> DataFrame:
    """groups, value, batch, entered, left: how many rows of a value begin and end in a batch."""
    both = F.array(F.struct(F.col("begin").alias("batch"), F.lit(1).alias("entered"), F.lit(0).alias("left")), F.struct(F.col("end").alias("batch"), F.lit(0).alias("entered"), F.lit(1).alias("left")))
    out = lives.select(*groups, "value", F.inline(both)).where((F.col("batch") >= 0) & (F.col("batch") < batches))
    return out.groupBy(*groups, "value", F.col("batch").cast("int").alias("batch")).agg(F.sum("entered").alias("entered"), F.sum("left").alias("left"))


def ranked(elements: DataFrame, asked: DataFrame, groups: list[str], batches: int, stretch: int = STRETCH) -> DataFrame:
    """groups, batch, name, value: the value of rank k (from 0) after a batch.

    ``elements`` is what ``elements_of`` returns, without null values; ``asked`` has groups, batch, name and
    k, which must be less than the number of rows present. Group columns must not be null.
    """
    low, high = elements.agg(F.min("value"), F.max("value")).first()
    if low is None:
        return asked.select(*groups, "batch", "name", F.lit(None).cast("long").alias("value"))
    apart = 64 if (low < 0) != (high < 0) else (low ^ high).bit_length()
    top = max(STEP, -(-apart // STEP) * STEP)
    node = lambda s: F.lit(0).cast("long") if s >= 64 else F.shiftright("value", s)

    def nodes(s: int) -> DataFrame:
        """A row per node: how many elements it has, and how many rows are present in it after each batch."""
        here = elements.groupBy(*groups, node(s).alias("node"))
        return here.agg(F.count("*").alias("size"), *[F.sum(F.when(F.col("batch") <= t, F.col("entered") - F.col("left")).otherwise(0)).alias(f"_{t}") for t in range(batches)])

    at = asked.join(nodes(top).select(*groups, "node", "size"), groups)
    found = []
    for s in range(top, 0, -STEP):
        at = shared_checkpoint(at.select(*groups, "batch", "name", "k", "node", "size"))
        small = (F.col("size") <= stretch) | (s == STEP)
        here = at.where(small)
        part = elements.withColumn("node", node(s)).join(here.select(*groups, "node").distinct(), [*groups, "node"], "left_semi")
        found.append((part.withColumn("bits", F.lit(s)), here.withColumn("bits", F.lit(s))))
        if s > STEP:
            children = nodes(s - STEP).select(*groups, (F.lit(0).cast("long") if s >= 64 else F.shiftright("node", STEP)).alias("_parent"), F.col("node").alias("_child"), F.col("size").alias("_size"), F.array(*[F.col(f"_{t}") for t in range(batches)]).alias("_n"))
            down = at.where(~small).withColumnRenamed("node", "_parent").join(children, [*groups, "_parent"]).withColumn("_here", F.get("_n", F.col("batch")))
            upto = F.sum("_here").over(Window.partitionBy(*groups, "batch", "name").orderBy("_child").rowsBetween(Window.unboundedPreceding, 0))
            down = down.withColumn("_upto", upto).where((F.col("k") < F.col("_upto")) & (F.col("k") >= F.col("_upto") - F.col("_here")))
            at = down.withColumn("k", F.col("k") - (F.col("_upto") - F.col("_here"))).drop("size").withColumnsRenamed({"_child": "node", "_size": "size"})
    parts, ranks = reduce(lambda a, b: a.unionByName(b), [f[0] for f in found]), reduce(lambda a, b: a.unionByName(b), [f[1] for f in found])
    ranks = ranks.select(*[F.col(c).alias(f"_{c}") for c in ranks.columns]).withColumnsRenamed({f"_{c}": c for c in ranks.columns})  # else Spark takes both sides' keys for the same columns
    keys = [*groups, "bits", "node"]
    kinds = ", ".join(f"`{g}` {elements.schema[g].dataType.simpleString()}" for g in groups)

    def run(elements: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = asked[[*groups, "batch", "name"]].copy()
        out["value"] = _stretch(elements, asked) if len(asked) else np.empty(0, np.int64)
        return out

    return parts.groupBy(*keys).cogroup(ranks.groupBy(*keys)).applyInPandas(run, f"{kinds}, batch int, name string, value long")


def distinct_items(lives: DataFrame, groups: list[str], batches: int) -> DataFrame:
    """groups, batch, change: by how many the number of distinct items present changes in a batch.

    An item's lives are reduced to one a beginning before they meet, and those that touch or overlap are
    merged, so a key has ``batches`` rows at most.
    """
    own = lives.where("item IS NOT NULL").select(*groups, "item", F.col("begin").cast("int").alias("begin"), F.least(F.coalesce("end", F.lit(batches)), F.lit(batches)).cast("int").alias("end"))
    own = own.where("begin >= 0 AND begin < end").groupBy(*groups, "item", "begin").agg(F.max("end").alias("end"))
    by = Window.partitionBy(*groups, "item").orderBy("begin")
    reach = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, 0))
    own = own.withColumn("_reach", reach).withColumn("_before", F.lag("_reach").over(by)).withColumn("_next", F.lead("begin").over(by))
    first = F.col("_before").isNull() | (F.col("begin") > F.col("_before"))
    last = F.col("_next").isNull() | (F.col("_next") > F.col("_reach"))
    ends = F.array(F.struct(F.when(first, F.col("begin")).alias("batch"), F.lit(1).alias("change")), F.struct(F.when(last, F.col("_reach")).alias("batch"), F.lit(-1).alias("change")))
    return own.select(*groups, F.inline(ends)).where(F.col("batch") < batches).groupBy(*groups, "batch").agg(F.sum("change").alias("change"))


NAMES = ["n_rows", "n_distinct", "total", "least", "greatest", "median"]


def maintained(lives: DataFrame, groups: list[str], batches: int) -> DataFrame:
    """batch, groups, old_ and new_ of each aggregate, for every batch and group in which one changes.

    ``lives`` has the group columns (not null), item, value (long), begin and end, null if it never ends: a
    row for each time that something is present, [begin, end) in batches from 0. Counts are of rows and of
    different items that are not null; total (0 without values), least, greatest and median (null without)
    are of values that are not null, the median being the one of rank n / 2, rounded down, from 0. Lives
    that end where they begin are never seen; an empty table gives no rows. Values whose sum leaves the
    range of a long raise Spark's overflow error.
    """
    lives = lives.where(F.col("end").isNull() | (F.col("begin") < F.col("end")))
    elements = shared_checkpoint(elements_of(lives, groups, batches))
    net = F.col("entered") - F.col("left")
    changes = elements.groupBy(*groups, "batch").agg(F.sum(net).alias("_rows"), F.sum(F.when(F.col("value").isNotNull(), net)).alias("_n"), F.sum(net * F.col("value")).alias("_total"))
    grid = elements.select(*groups).distinct().withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    state = grid.join(changes, [*groups, "batch"], "left").join(distinct_items(lives, groups, batches).withColumnRenamed("change", "_items"), [*groups, "batch"], "left")
    time = Window.partitionBy(*groups).orderBy("batch")
    upto = lambda c: F.coalesce(F.sum(c).over(time.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).cast("long")
    state = shared_checkpoint(state.select(*groups, "batch", upto("_rows").alias("n_rows"), upto("_items").alias("n_distinct"), upto("_total").alias("total"), upto("_n").alias("_n")))
    ranks = F.array(*[F.struct(F.lit(name).alias("name"), k.cast("long").alias("k")) for name, k in (("least", F.lit(0)), ("greatest", F.col("_n") - 1), ("median", F.floor(F.col("_n") / 2)))])
    asked = state.where("_n > 0").select(*groups, "batch", F.inline(ranks))
    values = ranked(elements.where("value IS NOT NULL"), asked, groups, batches)
    wide = values.groupBy(*groups, "batch").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in NAMES[3:]])
    state = state.join(wide, [*groups, "batch"], "left")
    before = {n: F.lag(n).over(time) for n in NAMES}
    both = state.select("batch", *groups, *[c for n in NAMES for c in ((F.coalesce(before[n], F.lit(0)) if n in NAMES[:3] else before[n]).cast("long").alias(f"old_{n}"), F.col(n).cast("long").alias(f"new_{n}"))])
    return both.where(reduce(lambda a, b: a | b, [~F.col(f"old_{n}").eqNullSafe(F.col(f"new_{n}")) for n in NAMES]))


def presence(id_col: Column, value: Column) -> Column:
    """The lives of a row as the contract deals them out by crc32 of its decimal id (null: of nothing).

    It enters in batch b and leaves q batches later; where 3 divides q it comes back in that batch for
    good, its value raised by q.
    """
    h = F.crc32(F.coalesce(id_col.cast("string"), F.lit("")))
    b, q = (h % 20).cast("int"), (F.floor(h / 20) % 4).cast("int")
    back = F.when(q % 3 == 0, F.struct((b + q).alias("begin"), F.lit(None).cast("int").alias("end"), (value + q).alias("value")))
    return F.filter(F.array(F.struct(b.alias("begin"), (b + q).alias("end"), value.alias("value")), back), lambda x: x.isNotNull())


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents by source and lang (null: empty), batches 0 to 19."""
    docs = table(spark, sf_dir, "documents")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    item = F.unhex(F.sha2(F.col("text"), 256)).alias("item")
    lives = docs.select(blank("source"), blank("lang"), item, F.inline(presence(F.col("doc_id"), F.col("n_chars").cast("long"))))
    return maintained(lives, ["source", "lang"], 20)


ORACLE_SQL = """
WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t
), hashed AS (
  SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, text, n_chars,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(list_filter(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: x <> ''), lambda x: ascii(x)::BIGINT)),
      lambda c, x: xor(c // 256, t[xor(c, x) % 256 + 1])), 4294967295) AS h
  FROM documents, crc
), dealt AS (
  SELECT *, h % 20 AS b, (h // 20) % 4 AS q FROM hashed
), lives AS (
  SELECT source, lang, text, n_chars AS v, b AS since, b + q AS until FROM dealt
  UNION ALL
  SELECT source, lang, text, n_chars + q, b + q, 1000 FROM dealt WHERE q % 3 = 0
), batches AS (
  SELECT unnest(range(20)) AS batch
), present AS (
  SELECT batch, source, lang, text, v, row_number() OVER (PARTITION BY batch, source, lang ORDER BY v NULLS LAST) AS place, count(v) OVER (PARTITION BY batch, source, lang) AS n
  FROM lives JOIN batches ON since <= batch AND batch < until
), state AS (
  SELECT batch, source, lang, count(*) AS n_rows, count(DISTINCT text) AS n_distinct, coalesce(sum(v), 0)::BIGINT AS total, min(v) AS least, max(v) AS greatest, max(CASE WHEN place = n // 2 + 1 AND v IS NOT NULL THEN v END) AS median
  FROM present GROUP BY ALL
), grid AS (
  SELECT batch, g.source, g.lang, coalesce(n_rows, 0) AS n_rows, coalesce(n_distinct, 0) AS n_distinct, coalesce(total, 0) AS total, least, greatest, median
  FROM (SELECT DISTINCT source, lang FROM lives) g CROSS JOIN batches LEFT JOIN state USING (batch, source, lang)
), both_ AS (
  SELECT batch::INTEGER AS batch, source, lang, coalesce(lag(n_rows) OVER w, 0) AS old_n_rows, n_rows AS new_n_rows, coalesce(lag(n_distinct) OVER w, 0) AS old_n_distinct, n_distinct AS new_n_distinct,
    coalesce(lag(total) OVER w, 0) AS old_total, total AS new_total, lag(least) OVER w AS old_least, least AS new_least, lag(greatest) OVER w AS old_greatest, greatest AS new_greatest, lag(median) OVER w AS old_median, median AS new_median
  FROM grid WINDOW w AS (PARTITION BY source, lang ORDER BY batch)
)
SELECT * FROM both_ WHERE old_n_rows <> new_n_rows OR old_n_distinct <> new_n_distinct OR old_total <> new_total
  OR old_least IS DISTINCT FROM new_least OR old_greatest IS DISTINCT FROM new_greatest OR old_median IS DISTINCT FROM new_median
"""
