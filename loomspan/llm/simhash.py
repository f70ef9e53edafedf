"""SimHash near-dedup by exact tiled comparison.

Fingerprints are compared with exclusive-or and bit counts in numpy. Every fingerprint belongs to a
cell, named by the bit counts of its four 16-bit quarters. Two fingerprints within the radius have
cells whose counts differ by no more than the radius in sum, so all other pairs of cells are skipped
unseen. A cell is cut into tiles of about ``tile`` fingerprints; the fingerprints of neighbouring
cells stream past each tile. A tile reports a spanning forest of its links instead of all of them, so
thousands of near copies cost no more rows than they are; components come from those links.
Equal fingerprints are one fingerprint throughout, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import connected_components, shared_checkpoint, table

SEED = 42
SLICE = 1 << 15  # hashes whose bits are counted at once
PAIRS = 1 << 20  # compared at once


def text_fingerprint(text: str | None, width: int) -> int:
    """The 64-bit SimHash of one text, as a signed integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change; the six ASCII blanks split
    if not words:
        return 0
    if len(words) <= width:
        return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words), SEED)).astype(np.int64))
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends)]
    digest = xxhash.xxh64_intdigest
    n, ones = len(words) - width + 1, np.zeros(64, np.int64)
    for a in range(0, n, SLICE):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[a : min(n, a + SLICE)], ends[a + width - 1 :], strict=False)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(row, doc_id, fp) for every row; a text without words, or null, has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([text_fingerprint(t, width) for t in b.column(2).to_pylist()], pa.int64())], names=["row", "doc_id", "fp"])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "row long, doc_id long, fp long")


def cell_of(fp: str) -> Column:
    """The bit counts of the quarters, five bits each, as one number."""
    quarters = [F.bit_count(F.shiftrightunsigned(F.col(fp), 16 * i).bitwiseAND(F.lit(0xFFFF))) for i in range(4)]
    return sum((q * 32**i for i, q in enumerate(quarters[1:], 1)), quarters[0]).cast("int")


def neighbour_steps(radius: int) -> list[int]:
    """Steps to the cells after a cell whose four counts differ by the radius or less in sum."""
    near = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    return sorted(s for d in near if (s := sum(x * 32**i for i, x in enumerate(d))) > 0)


def tile_links(radius: int):
    """A function over (place, kind, fp) rows sorted so that a tile's own rows precede its visitors."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, own, parent = None, np.empty(0, np.uint64), np.empty(0, np.int64)

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def join(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
            """Links between own rows that were not yet connected."""
            made = []
            for x, y in np.unique(np.stack([a, b]), axis=1).T.tolist():
                p, q = root(x), root(y)
                if p != q:
                    parent[max(p, q)] = min(p, q)
                    made.append((x, y))
            return made

        def near(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            step = max(1, PAIRS // max(1, len(right)))
            for a in range(0, len(left), step):
                i, j = np.nonzero(np.bitwise_count(left[a : a + step, None] ^ right[None, :]) <= radius)
                if len(i):
                    yield i + a, j

        for b in batches:
            places, kinds, fps = (b.column(c).to_numpy(zero_copy_only=False) for c in ("place", "kind", "fp"))
            fps, out = fps.view(np.uint64), []
            cuts = np.flatnonzero(np.diff(places)) + 1
            for a, z in zip([0, *cuts], [*cuts, len(places)], strict=True):
                if a == z:
                    continue
                if place != places[a]:
                    place, own, parent = places[a], np.empty(0, np.uint64), np.empty(0, np.int64)
                first = a + int(np.searchsorted(kinds[a:z], 1))
                if first > a:
                    fresh, old = fps[a:first], len(own)
                    own, parent = np.concatenate([own, fresh]), np.concatenate([parent, np.arange(old, old + len(fresh))])
                    for i, j in near(fresh, own):
                        later = i + old > j
                        out += [(own[x], own[y]) for x, y in join((i + old)[later], j[later])]
                if z > first and len(own):
                    seen = fps[first:z]
                    for i, j in near(seen, own):  # i ascends, so the first link of each visitor is at a change of i
                        head = np.append(True, i[1:] != i[:-1])
                        lead = j[head][np.cumsum(head) - 1]
                        out += list(zip(seen[i[head]], own[j[head]], strict=True))
                        out += [(own[x], own[y]) for x, y in join(lead[~head], j[~head])]
            if out:
                u, v = np.array(out, np.uint64).T
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(u).view(np.int64)), pa.array(np.ascontiguousarray(v).view(np.int64))], names=["u", "v"])

    return links


def near_links(fps: DataFrame, radius: int = 3, tile: int = 4096) -> DataFrame:
    """Links (u, v) that connect all of the distinct values of ``fps.fp`` within the radius.

    Not every close pair is listed, but any two that are close are connected by the links listed.
    """
    cells = fps.select("fp", cell_of("fp").alias("cell"))
    # a cell is four counts of 0 to 16, so this table has at most 17 ** 4 = 83521 rows at any scale
    sizes = F.broadcast(cells.groupBy("cell").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")))
    own = cells.join(sizes, "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), "tiles").cast("int"))
    place = lambda c, t: (F.col(c).cast("long") * F.lit(2**31) + t).alias("place")
    home = own.select(place("cell", F.col("tile")), F.lit(0).cast("byte").alias("kind"), "fp")
    later = own.where("tiles > tile + 1").select("cell", "fp", F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)).alias("tile"))
    within = later.select(place("cell", F.col("tile")), F.lit(1).cast("byte").alias("kind"), "fp")
    steps = F.array(*[F.lit(s) for s in neighbour_steps(radius)])
    around = cells.select("fp", "cell", F.explode(steps).alias("step")).select("fp", (F.col("cell") + F.col("step")).alias("cell"))
    around = around.join(sizes, "cell").select("cell", "fp", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    visit = around.select(place("cell", F.col("tile")), F.lit(1).cast("byte").alias("kind"), "fp")
    rows = home.unionByName(within).unionByName(visit).repartition("place").sortWithinPartitions("place", "kind")
    return rows.mapInArrow(tile_links(radius), "u long, v long")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 3, tile: int = 4096) -> DataFrame:
    """SimHash fingerprint and component of every row of ``docs``.

    Returns row, doc_id, fingerprint (16 lower-case hex digits), component_id (the smallest id that can
    be reached over links of ``radius`` or fewer differing bits, the row's own included) and kept (true
    for one row of each component: the first with that id, or the first of all if no id is known). Texts with
    fewer than ``width`` words are hashed whole; empty, blank and null texts have fingerprint zero
    and are linked like any other. Null ids keep their row and never name a component unless all ids
    of it are null. Repeated rows keep their number. An empty table gives no rows; extra columns are
    left out.
    """
    rows = shared_checkpoint(fingerprints(docs, id_col, text_col, width))
    distinct = shared_checkpoint(rows.groupBy("fp").agg(F.min(F.struct(F.isnull("doc_id").alias("unknown"), "doc_id", "row")).alias("least")))
    comp = connected_components(near_links(distinct, radius, tile))
    named = distinct.join(comp, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("least").alias("best"))
    # one row per fingerprint; a fingerprint that very many rows share is split by the adaptive skew join
    by_fp = named.join(least, "component").select("fp", F.col("best.doc_id").alias("component_id"), F.col("best.row").alias("keep_row"))
    return rows.join(by_fp, "fp").select("row", "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", (F.col("row") == F.col("keep_row")).alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component stays: the first with the smallest id. ``docs`` must be a table that rereads alike."""
    lost = near_dedup(docs).where("NOT kept").select(F.col("row").alias("_row"))
    return docs.withColumn("_row", F.monotonically_increasing_id()).join(lost, "_row", "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).drop("row", "kept")


#: Bitwise majorities over shingles and transitive links: tested against brute force instead.
ORACLE_SQL = None
