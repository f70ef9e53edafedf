"""Mixing sources to target weights with Sainte-Lague apportionment.

The words of the mix go to the sources by highest quotients (a source's target over 1, 3, 5, ...), and
each source's quota goes to its clusters of shards, and theirs to the shards, the same way by size. Quotas are in words, so that small
sources meet their targets too. A shard is a seeded part of a source's documents, laid out in seeded
order and cut into equal blocks; whole turns over the shard are taken as often as its quota asks, and
the blocks of the last, partial turn are picked by a seeded permutation, the last of them in part. A
source that holds a third of all rows has as many more shards.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import WORD, shared_checkpoint, split_join, table

WEIGHTS = (5.0, 2.0, 1.0)  # repeating, over the sources by code point, null last
# Primes below 2 ** 31, larger than the number of blocks of any shard.
STEPS = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497, 2147483489, 2147483477)


def apportion(votes: np.ndarray, seats: int, most: np.ndarray | None = None) -> np.ndarray:
    """Sainte-Lague seats by highest quotients; ties go to the earlier entry, ``most`` bounds each entry."""
    votes = np.asarray(votes, float)
    most = np.full(len(votes), seats) if most is None else np.asarray(most)
    got = np.zeros(len(votes), np.int64)
    if seats <= 0 or not (votes > 0).any():
        return got
    # Start below the answer: rounding at a divisor that hands out too few seats, found by bisection.
    low, high = votes.sum() / (seats + len(votes) + 1.0) / 4, 2.0 * votes.sum() + 1
    at = lambda d: np.minimum(np.where(votes > 0, np.floor(votes / d + 0.5), 0), most).astype(np.int64)
    for _ in range(200):
        mid = (low * high) ** 0.5
        low, high = (mid, high) if at(mid).sum() > seats else (low, mid)
    got = np.minimum(at(high * (1 + 1e-12)), most)
    heap = [(-v / (2 * g + 1), i) for i, (v, g, m) in enumerate(zip(votes, got, most, strict=True)) if v > 0 and g < m]
    heapq.heapify(heap)
    for _ in range(seats - int(got.sum())):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def fill(weights: np.ndarray, caps: np.ndarray, total: float) -> np.ndarray:
    """Share ``total`` by weight; what would exceed a cap is shared again by weight until none does."""
    target, open_ = np.zeros(len(caps)), np.ones(len(caps), bool)
    while open_.any():
        left = total - target[~open_].sum()
        share = left * weights / weights[open_].sum()
        over = open_ & (share > caps)
        if not over.any():
            target[open_] = share[open_]
            break
        target[over], open_ = caps[over], open_ & ~over
    return target


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, repeat: int = 3, block: int = 64, shard_rows: int = 2000, cluster: int = 1024, seed: int = 7) -> DataFrame:
    """How many words the mix takes of every document.

    Returns row, doc_id, source, size (words), source_size, target (the source's share of all words),
    taken (words, repeats counted; at most ``repeat`` times the size) and copies (whole documents that
    stand for the taken words). Words are runs of anything but
    ASCII blanks; null and blank texts have size 0 and nothing is taken of them. A null source is a
    source of its own, last in the order; ``weights`` repeat over the sources in code point order.
    Repeated rows are documents of their own. Reruns agree: order and choice come from hashes of the
    id and ``seed``; rows without an id are told apart by their place in the table. An empty table gives no rows; other columns are
    left out. A single task reads the table of sources, one row each; a source's quota is shared
    between clusters of ``cluster`` shards (of ``shard_rows`` documents each) and a cluster's between
    its shards, so no task reads all shards of a large source. The rows of a large source are split
    when they meet its target.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col(source_col).cast("string")
    # one key for a source: a null is told from every name by its first character
    name = F.when(source.isNull(), "-").otherwise(F.concat(F.lit("+"), source)).alias("key")
    rows = shared_checkpoint(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), source.alias("source"), name, size.alias("size")))
    sizes = rows.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(order=[(k[0] == "-", k.encode()) for k in pdf.key]).sort_values("order").reset_index(drop=True)
        caps = pdf.source_size.to_numpy(float)
        w = np.array([weights[i % len(weights)] for i in range(len(pdf))])
        target = fill(w, repeat * caps, caps.sum())
        quota = apportion(target, int(caps.sum()), repeat * pdf.source_size.to_numpy())
        return pdf.assign(target=target, quota=quota)[["key", "source_size", "target", "quota", "n"]]

    sources = sizes.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(plan, "key string, source_size long, target double, quota long, n long")
    sources = shared_checkpoint(sources.withColumn("shards", F.ceil(F.col("n") / shard_rows).cast("int")))

    identity = F.coalesce(F.col("doc_id"), F.lit(-1))
    order = F.xxhash64(identity, F.lit(seed))
    dealt = split_join(rows, sources, "key", "n", F.xxhash64("row"))
    # rows without an id are dealt out by their place, rows that share one by their size
    apart = F.when(F.col("doc_id").isNull(), F.col("row")).otherwise(F.col("size"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64(identity, apart, F.lit(seed + 1)), "shards").cast("int"))
    by_shard = shared_checkpoint(dealt.groupBy("key", "shard").agg(F.sum("size").alias("words"), F.first("quota").alias("quota")).withColumn("cluster", F.floor(F.col("shard") / cluster).cast("int")))

    def share(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part").reset_index(drop=True)
        words = pdf.words.to_numpy()
        return pdf.assign(quota=apportion(words, int(pdf.quota.iloc[0]), repeat * words))[["key", "part", "words", "quota"]]

    parts = "key string, part int, words long, quota long"
    clusters = by_shard.groupBy("key", "cluster").agg(F.sum("words").alias("words"), F.first("quota").alias("quota")).withColumnRenamed("cluster", "part").groupBy("key").applyInPandas(share, parts)
    shards = by_shard.select("key", "cluster", F.col("shard").alias("part"), "words").join(clusters.select("key", F.col("part").alias("cluster"), "quota"), ["key", "cluster"]).groupBy("key", "cluster").applyInPandas(share, parts)
    blocks = F.when(F.col("words") > 0, F.greatest(F.lit(1), F.round(F.col("words") / block))).otherwise(0).cast("long")
    shards = shared_checkpoint(shards.select("key", F.col("part").alias("shard"), "words", blocks.alias("blocks"), F.col("quota").alias("shard_quota")))
    laid = dealt.join(shards, ["key", "shard"])
    w = Window.partitionBy("key", "shard").orderBy(order, "doc_id", "row")
    laid = laid.withColumn("end", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("size"))
    taken, copies = taken_words(seed)
    return laid.select("row", "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"))


def taken_words(seed: int) -> tuple[Column, Column]:
    """Whole turns of a document plus its words in the picked parts of the partial turn, and its copies:

    the turns, and one more if the document's first word is picked. Block k of n covers the words from
    floor(k * words / n) to floor((k + 1) * words / n). It is picked when (a * k + c) mod n is below the
    number of whole blocks wanted: a permutation, as ``a`` is a prime larger than any n here, hence
    coprime to n; both ``a`` and c are chosen by the seed. The block next in that order gives its first
    words for the rest of the quota.
    """
    words, n = F.col("words"), F.greatest(F.col("blocks"), F.lit(1))
    div = lambda a, b: F.call_function("div", a, b)
    turns = div(F.col("shard_quota"), F.greatest(words, F.lit(1)))
    left = F.col("shard_quota") - turns * words
    want = div(left * n, F.greatest(words, F.lit(1)))
    rest = left - div(want * words, n)
    step = F.pmod(F.get(F.array(*[F.lit(p) for p in STEPS]), F.pmod(F.xxhash64("shard", "key", F.lit(seed)), F.lit(len(STEPS))).cast("int")), n)
    shift = F.pmod(F.xxhash64("key", "shard", F.lit(seed)), n)
    edge = lambda k: div(k * words, n)
    at = lambda k: F.pmod(step * k + shift, n)
    upto = lambda k: F.when(at(k) < want, edge(k + 1)).otherwise(F.least(edge(k) + rest, edge(k + 1)))
    # the blocks that the document touches; a bound too many on either side adds nothing
    low = F.greatest(div(F.col("begin") * n, F.greatest(words, F.lit(1))) - 1, F.lit(0))
    high = F.least(div(F.col("end") * n, F.greatest(words, F.lit(1))) + 1, n - 1)

    def part(total: Column, k: Column) -> Column:
        inside = F.greatest(F.least(upto(k), F.col("end")) - F.greatest(edge(k), F.col("begin")), F.lit(0))
        return total + F.when(at(k) <= want, inside).otherwise(0)

    some = (left > 0) & (F.col("size") > 0)
    partial = F.when(some, F.aggregate(F.sequence(low, F.greatest(low, high)), F.lit(0).cast("long"), part)).otherwise(F.lit(0))
    first = div((F.col("begin") + 1) * n - 1, F.greatest(words, F.lit(1)))  # the block of the document's first word
    picked = some & (at(first) <= want) & (F.col("begin") < upto(first))
    copies = F.when(F.col("size") > 0, turns + picked.cast("int")).otherwise(0)
    return (turns * F.col("size") + partial).cast("long"), copies.cast("int")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: each document as many times as its shard's blocks ask for, whole.

    The last, partial turn takes a document if the block that holds its first word is picked, so a
    source's words stay near its target and no text is cut. Columns stay as they are. Documents without
    a word are not taken. ``docs`` must be a table that rereads alike.
    """
    copies = mix(docs).where("copies > 0").select(F.col("row").alias("_row"), F.col("copies").alias("_copies"))
    mixed = docs.withColumn("_row", F.monotonically_increasing_id()).join(copies, "_row")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("row", "source", "copies")


#: The seeded choice of blocks has no SQL twin; tested against a brute-force version.
ORACLE_SQL = None
