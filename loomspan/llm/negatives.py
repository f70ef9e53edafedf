"""Hard negatives by an exact nearest-neighbour join over a Voronoi partition.

The largest inner product becomes the smallest distance by one more coordinate: a row x of norm n gets
sqrt(M^2 - n^2), M being the largest norm, an anchor q gets 0, and then |q - x|^2 = |q|^2 + M^2 - 2 q.x. A
bounded sample of rows are the pivots; each row belongs to the cell of its nearest one. Within a cell rows
are ordered by their distance to the pivot and packed into blocks of rows, each with its least and greatest
distance. By the triangle inequality a row within r of an anchor has a distance to a pivot that differs
from the anchor's by r at most; the interval that this leaves, joined over a group of anchors, says which
blocks of a cell the group might need, and only those are copied to it. Each group then meets its blocks in
tasks of their own, one block at a time, in an exact join by matrix products.

Two rounds: positives, where blocks and groups are of one label and r comes from the counts and radii of
the label's cells, and negatives, where r comes from the positives' scores. Distances only decide what is
copied, with a margin for rounding; scores are integers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import shared_checkpoint, table

PIVOTS = 64  # rows that span the cells
BLOCK = 256  # rows of a block
ANCHORS = 256  # anchors of a group
RUN = 256  # blocks that a group meets in one task
NONE = np.iinfo(np.int64).max  # id of no row, and of a row without one: it loses every tie
MARGIN = 1e-6
_COPIED = "label long, cell int, block long, lo double, hi double, n long, rows binary"


def scaled(vector: Column, by: int = 256) -> Column:
    """floor(by * x) of each component as an integer; null unless every component is there and finite."""
    whole = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & whole, F.transform(vector, lambda x: F.floor(x.cast("double") * by).cast("int")))


def packed(rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> bytes:
    """One block as bytes: numbers of rows and components, then row numbers, ids, labels, components."""
    return b"".join([np.array(vectors.shape, np.int64).tobytes(), rows.astype(np.int64).tobytes(), ids.astype(np.int64).tobytes(), labels.astype(np.int64).tobytes(), vectors.astype(np.int32).tobytes()])


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, dims = np.frombuffer(data, np.int64, 2)
    longs = np.frombuffer(data, np.int64, 3 * n, 16).reshape(3, n)
    return longs[0], longs[1], longs[2], np.frombuffer(data, np.int32, n * dims, 16 + 24 * n).reshape(n, dims)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    sizes = np.asarray(column.value_lengths())
    out = np.zeros((len(sizes), dims), np.int32)
    out[np.arange(dims)[None, :] < sizes[:, None]] = np.asarray(column.flatten())
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: in floating point where no sum can leave its exact range."""
    most = float(np.abs(a, dtype=np.float64).max(initial=0)) * float(np.abs(b, dtype=np.float64).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise OverflowError("inner products leave the range of a long")
    return a.astype(np.int64) @ b.astype(np.int64).T


def augmented(x: np.ndarray, most: float) -> np.ndarray:
    x = x.astype(np.float64)
    return np.concatenate([x, np.sqrt(np.maximum(0, most - (x * x).sum(axis=1)))[:, None]], axis=1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)))


def merged(scores: np.ndarray, ids: np.ndarray, more_scores: np.ndarray, more_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of two lists of (score, id) along the last axis, as many as the first list has."""
    s, i = np.concatenate([scores, more_scores], axis=-1), np.concatenate([ids, more_ids], axis=-1)
    order = np.lexsort((i, -s), axis=-1)[..., : scores.shape[-1]]
    return np.take_along_axis(s, order, -1), np.take_along_axis(i, order, -1)


class Space:
    """Pivots and the largest squared norm: what tasks need to place a row. Bounded by ``PIVOTS`` rows."""

    def __init__(self, placed: DataFrame, pivots: int):
        self.most, self.dims = placed.agg(F.max("norm"), F.max(F.size("vector"))).first()
        self.most, self.dims = float(self.most or 0), max(1, self.dims or 0)
        some = placed.select("vector").orderBy(F.xxhash64("row"), "row").limit(pivots).collect()
        rows = sorted({tuple(r["vector"]) + (0,) * (self.dims - len(r["vector"])) for r in some}) or [(0,) * self.dims]
        self.pivots = augmented(np.array(rows, np.int64).reshape(len(rows), self.dims), self.most)
        self.slack = MARGIN * (1 + math.sqrt(self.most))


def blocks(placed: DataFrame, space: Space, by_label: bool) -> DataFrame:
    """label (0 if not by label), cell, block, lo, hi, n, rows: up to ``BLOCK`` rows each, alike in distance."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = distances(augmented(matrix(b.column("vector"), space.dims), space.most), space.pivots)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(d)), cell])], names=[*b.schema.names, "cell", "d"])

    rows = placed.select("row", "vec_id", "label", "vector").mapInArrow(place, "row long, vec_id long, label long, vector array<int>, cell int, d double")
    keys = [*(["label"] if by_label else []), "cell"]
    order = [*keys, "d", F.xxhash64("row")]  # the hash, so that rows at one distance may lie in several partitions
    parts = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def cut(t: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table]:
            key = np.stack([t.column(k).to_numpy() for k in keys], 1)
            ends = np.append(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, len(key)) if len(key) else np.empty(0, int)
            begins = np.append(0, ends[:-1])[: len(ends)]
            spans = [(a, min(a + BLOCK, z)) for s, z in zip(begins, ends, strict=True) for a in range(s, z, BLOCK)]
            if spans and not last:  # the last one may go on in the next batch
                spans, keep = spans[:-1], spans[-1][0]
            else:
                keep = len(key)
            found = []
            for a, z in spans:
                s = t.slice(a, z - a).combine_chunks()
                ids = s.column("vec_id").fill_null(int(NONE)).to_numpy()
                d = s.column("d").to_numpy()
                of = s.column("row").to_numpy()
                data = packed(of, ids, s.column("label").to_numpy(), matrix(s.column("vector").combine_chunks(), space.dims))
                found.append((int(s.column("label")[0].as_py()) if by_label else 0, int(s.column("cell")[0].as_py()), int(of.min()), float(d.min()), float(d.max()), z - a, data))
            made = [pa.array([f[k] for f in found], kind) for k, kind in enumerate([pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.binary()])]
            return pa.RecordBatch.from_arrays(made, names=["label", "cell", "block", "lo", "hi", "n", "rows"]) if found else None, t.slice(keep)

        for b in batches:
            t = pa.Table.from_batches([b])
            made, rest = cut(t if rest is None else pa.concat_tables([rest, t]), False)
            if made is not None:
                yield made
        if rest is not None and (made := cut(rest, True)[0]) is not None:
            yield made

    return shared_checkpoint(rows.mapInArrow(pack, _COPIED))


def met(groups: DataFrame, wanted: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Each group's anchors and the blocks that it wants, in runs: side 0 and 1 of (label, grp, run, side, block, rows).

    ``wanted`` has for each group and cell the interval of distances within which it wants rows, and the
    least distance (``far``) that a block's greatest must reach.
    """
    own = wanted.withColumnsRenamed({"lo": "_lo", "hi": "_hi"})
    own = own if "label" in keys else own.drop("label")
    there = cells if "label" in keys else cells.drop("label")
    copied = there.join(own, keys).where((F.col("hi") >= F.col("_lo")) & (F.col("lo") <= F.col("_hi")) & (F.col("hi") >= F.col("far")))
    label = F.col("label") if "label" in keys else F.lit(0).cast("long")
    runs = max(1, -(-cells.count() // RUN))
    copied = copied.select(label.alias("label"), "grp", F.pmod(F.xxhash64("block"), F.lit(runs)).cast("int").alias("run"), F.lit(1).alias("side"), "block", "rows")
    every = copied.select("label", "grp", "run").distinct()
    anchors = groups.join(every, ["label", "grp"]).select("label", "grp", "run", F.lit(0).alias("side"), F.lit(0).cast("long").alias("block"), "rows")
    both = anchors.unionByName(copied)
    # runs are dealt out by name, so that each is whole in one task; a task holds its anchors and one block
    return both.repartition(int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions")), "label", "grp", "run").sortWithinPartitions("label", "grp", "run", "side", "block")


def joined(pairs: DataFrame, begin, meet, end, schema: str) -> DataFrame:
    """``begin`` gets a group's anchors, ``meet`` the state and one block after the other, ``end`` the state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            for side, data in zip(b.column("side").to_pylist(), b.column("rows"), strict=True):
                if side == 0:
                    if state is not None:
                        yield end(state)
                    state = begin(data.as_py())
                else:
                    meet(state, *unpacked(data.as_py()))
        if state is not None:
            yield end(state)

    return pairs.select("side", "rows").mapInArrow(run, schema)


def _grouped(anchors: DataFrame, wants: str, space: Space, by_label: bool) -> tuple[DataFrame, DataFrame]:
    """(groups, wanted): anchors packed with what they ask, and each group's interval for every cell.

    ``anchors`` has row, vec_id, label, vector and the array ``asks`` (rank and score of the positives, or
    empty); ``wants`` names arrays of an interval's ends by cell. Groups are cells of the anchors over as many pivots
    as make some ``ANCHORS`` in each, dealt out by hash where there are more.
    """
    n = anchors.count()
    some = space.pivots[: max(1, min(len(space.pivots), -(-n // ANCHORS)))]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("vector"), space.dims).astype(np.float64)
            d = distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1), some)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(d.argmin(axis=1).astype(np.int64))], names=[*b.schema.names, "grp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in anchors.schema)
    placed = shared_checkpoint(anchors.mapInArrow(near, schema + ", grp long"))
    key = ["label", "grp"]
    placed = placed if by_label else placed.withColumn("own", F.col("label")).withColumn("label", F.lit(0).cast("long"))
    sizes = placed.groupBy(*key).agg(F.ceil(F.count("*") / ANCHORS).alias("_parts"))
    placed = placed.join(sizes, key).withColumn("grp", F.col("grp") * (1 << 32) + F.pmod(F.xxhash64("row"), F.col("_parts"))).drop("_parts")
    wanted = placed.select(*key, F.posexplode(wants)).groupBy(*key, F.col("pos").alias("cell")).agg(F.min("col.lo").alias("lo"), F.max("col.hi").alias("hi"), F.min("col.far").alias("far"))
    own = F.col("label") if by_label else F.col("own")
    groups = placed.groupBy(*key).agg(F.collect_list(F.struct("row", "vec_id", own.alias("label"), "vector", "asks")).alias("all"))
    dims = space.dims

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = []
            for group in b.column("all").to_pylist():
                v = np.zeros((len(group), dims), np.int32)
                for i, x in enumerate(group):
                    v[i, : len(x["vector"])] = x["vector"]
                asks = np.zeros((len(group), max([1, *(len(x["asks"]) for x in group)]), 2), np.int64)
                for i, x in enumerate(group):
                    for j, ask in enumerate(x["asks"]):
                        asks[i, j] = ask["positive_id"] if ask["positive_id"] is not None else NONE, ask["score"]
                    asks[i, len(x["asks"]) :] = NONE, -1
                head = packed(*[np.array([x[c] for x in group], np.int64) for c in ("row", "vec_id", "label")], v)
                data.append(np.array([len(head), asks.shape[1]], np.int64).tobytes() + head + asks.tobytes())
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("grp"), pa.array(data, pa.binary())], names=["label", "grp", "rows"])

    return groups.mapInArrow(pack, "label long, grp long, rows binary"), wanted


def _anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    size, asks = np.frombuffer(data, np.int64, 2)
    rows, ids, labels, vectors = unpacked(data[16 : 16 + size])
    return rows, ids, labels, vectors, np.frombuffer(data, np.int64, len(rows) * asks * 2, 16 + size).reshape(len(rows), asks, 2)


def _ids(x: np.ndarray) -> pa.Array:
    return pa.array(x, mask=x == NONE)


def first_positives(cells: DataFrame, anchors: DataFrame, space: Space, most: int) -> DataFrame:
    """row, positive_id, score: the ``most`` best other rows of an anchor's label, a row each."""
    near = F.min(F.when(F.col("n") > most, F.col("hi")))  # a block that has enough rows, itself among them
    stats = cells.groupBy("label", "cell").agg(near.alias("near"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    stats = stats.select("label", F.struct("cell", F.coalesce("near", "hi").alias("r"), F.when(F.col("near").isNotNull(), F.lit(most + 1)).otherwise(F.col("n")).cast("long").alias("n")).alias("s"))
    stats = stats.groupBy("label").agg(F.collect_list("s").alias("stats"))  # as many as there are pivots

    def interval(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("vector"), space.dims).astype(np.float64)
            d = distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1), space.pivots)
            out = []
            for i, s in enumerate(b.column("stats").to_pylist()):
                cell, r, n = (np.array([y[k] for y in s]) for k in ("cell", "r", "n"))
                reach = d[i, cell] + r  # no row of the cell that is counted lies farther
                order = np.argsort(reach)
                enough = np.flatnonzero(np.cumsum(n[order]) > most)
                limit = reach[order[enough[0]]] + space.slack if len(enough) else np.inf
                out.append([{"lo": a - limit, "hi": a + limit, "far": -np.inf} for a in d[i]])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.list_(pa.struct([("lo", pa.float64()), ("hi", pa.float64()), ("far", pa.float64())])))], names=[*b.schema.names[:-1], "wants"])

    asked = anchors.join(stats, "label").select("row", "vec_id", "label", "vector", "asks", "stats")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema if f.name != "stats")
    asked = asked.mapInArrow(interval, schema + ", wants array<struct<lo:double,hi:double,far:double>>")
    groups, wanted = _grouped(asked, "wants", space, True)
    low = np.iinfo(np.int64).min + 1

    def begin(data: bytes) -> list:
        rows, _, _, vectors, _ = _anchors(data)
        return [rows, vectors, np.full((len(rows), most), low), np.full((len(rows), most), NONE), np.zeros((len(rows), most), bool)]

    def meet(state: list, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        score = products(state[1], vectors)
        score[state[0][:, None] == rows[None, :]] = low
        order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=-1)[:, :most]
        state[2], state[3] = merged(state[2], state[3], np.take_along_axis(score, order, 1), np.broadcast_to(ids, score.shape)[np.arange(len(score))[:, None], order])

    def end(state: list) -> pa.RecordBatch:
        there = state[2] > low
        return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(state[0][:, None], there.shape)[there]), _ids(state[3][there]), pa.array(state[2][there])], names=["row", "positive_id", "score"])

    found = joined(met(groups, wanted, cells, ["label", "cell"]), begin, meet, end, "row long, positive_id long, score long")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("positive_id")))
    return found.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def mined(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, pivots: int = PIVOTS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, as the contract describes.

    ``rows`` has vec_id, label and vector (array of int); rows with a null label or vector take no part. A
    negative's score lies between ``low`` and ``high`` hundredths of the positive's. Rows are told apart by
    their place: copies of a row, and rows that share an id, are other rows, and each is an anchor by itself. A row
    without id is no anchor; it comes last among equals. Vectors of unequal length are filled up with
    zeros. An empty table, or one without anchors, gives no rows. Components must fit an int and scores a
    long; else an error is raised.
    """
    own = rows.where("label IS NOT NULL AND vector IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "vector", F.coalesce(anchor, F.lit(False)).alias("anchor"))
    own = own.withColumn("norm", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    placed = shared_checkpoint(own)  # rows keep their numbers
    space = Space(placed, pivots)
    anchors = placed.where("anchor").select("row", "vec_id", "label", "vector").withColumn("asks", F.array().cast("array<struct<positive_id:bigint,score:bigint>>"))
    best = shared_checkpoint(first_positives(blocks(placed, space, True), anchors, space, positives))
    # below zero no score lies between the hundredths, so such positives have no negatives
    asks = best.where("score >= 0").groupBy("row").agg(F.collect_list(F.struct("positive_id", "score")).alias("asks"), F.min("score").alias("_least"), F.max("score").alias("_most"))
    asked = anchors.drop("asks").join(asks, "row").select("row", "vec_id", "label", "vector", "asks", "_least", "_most")

    def interval(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("vector"), space.dims).astype(np.float64)
            d = distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1), space.pivots)
            whole = (x * x).sum(axis=1) + space.most
            outer = np.sqrt(np.maximum(0, whole - 2 * low / 100 * np.asarray(b.column("_least"), dtype=np.float64))) + space.slack
            inner = np.sqrt(np.maximum(0, whole - 2 * high / 100 * np.asarray(b.column("_most"), dtype=np.float64))) - space.slack
            out = [[{"lo": a - o, "hi": a + o, "far": i - a} for a in row] for row, o, i in zip(d, outer, inner, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(out, pa.list_(pa.struct([("lo", pa.float64()), ("hi", pa.float64()), ("far", pa.float64())])))], names=[*b.schema.names[:5], "wants"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields[:5])
    asked = asked.mapInArrow(interval, schema + ", wants array<struct<lo:double,hi:double,far:double>>")
    groups, wanted = _grouped(asked, "wants", space, False)
    none = np.iinfo(np.int64).min + 1

    def begin(data: bytes) -> list:
        rows, ids, labels, vectors, asks = _anchors(data)
        shape = (*asks.shape[:2], negatives)
        return [rows, ids, labels, vectors, asks, np.full(shape, none), np.full(shape, NONE)]

    def meet(state: list, rows: np.ndarray, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        score = products(state[3], vectors)
        fit = state[2][:, None] != labels[None, :]
        order = np.lexsort((np.broadcast_to(ids, score.shape), -score, ~fit), axis=-1)  # those of the same label last
        s, i = np.take_along_axis(score, order, 1), np.broadcast_to(ids, score.shape)[np.arange(len(score))[:, None], order]
        known = np.arange(score.shape[1])[None, :] < fit.sum(axis=1)[:, None]
        for j in range(state[4].shape[1]):
            upto = state[4][:, j, 1:]
            # the first that is not above the positive, and the few after it
            begin = ((100 * s > high * upto) & known).sum(axis=1)
            at = np.minimum(begin[:, None] + np.arange(negatives)[None, :], score.shape[1] - 1)
            real = (begin[:, None] + np.arange(negatives)[None, :] < known.sum(axis=1)[:, None]) & (upto >= 0)
            got = np.take_along_axis(s, at, 1)
            real &= (100 * got >= low * upto) & (100 * got <= high * upto)
            state[5][:, j], state[6][:, j] = merged(state[5][:, j], state[6][:, j], np.where(real, got, none), np.where(real, np.take_along_axis(i, at, 1), NONE))

    def end(state: list) -> pa.RecordBatch:
        there = state[5] > none
        wide = lambda x: np.broadcast_to(x, there.shape)[there]
        columns = [pa.array(wide(state[0][:, None, None])), pa.array(wide(state[1][:, None, None])), pa.array(wide(np.arange(there.shape[1])[None, :, None])), _ids(wide(state[4][:, :, :1])), pa.array(wide(state[4][:, :, 1:])), _ids(state[6][there]), pa.array(state[5][there])]
        return pa.RecordBatch.from_arrays(columns, names=["row", "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"])

    pairs = met(groups, wanted, blocks(placed, space, False), ["cell"])
    found = joined(pairs, begin, meet, end, "row long, anchor_id long, place long, positive_id long, positive_score long, negative_id long, negative_score long")
    place = F.row_number().over(Window.partitionBy("row", "place").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id")))
    return found.withColumn("rank", place).where(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = rows.select("vec_id", label.alias("label"), scaled(F.col("embedding")).alias("vector"))
    return mined(rows, F.col("vec_id") % 100 == 0)


ORACLE_SQL = """
WITH rows_ AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.r, a.vec_id AS anchor_id, b.r AS other, b.vec_id AS other_id, a.label = b.label AS same, list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2]))::BIGINT AS score
  FROM rows_ a JOIN rows_ b ON a.r <> b.r WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, other_id) <= 5
)
SELECT p.anchor_id, p.other_id AS positive_id, row_number() OVER (PARTITION BY p.r, p.other ORDER BY n.score DESC, n.other_id)::INTEGER AS rank, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.r = n.r AND NOT n.same AND 80 * p.score <= 100 * n.score AND 100 * n.score <= 100 * p.score
QUALIFY rank <= 5
"""
