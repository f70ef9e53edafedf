"""Repeated-string removal by bucket-pointer refinement over sampled suffixes.

Every position starts in the bucket of its 8-gram, whose identifier is the 8 bytes themselves. Buckets
are refined by the identifiers of later offsets: the bucket of 2q bytes at p is named by the pair of
identifiers at p and p + q, and the refined names are used again for the next doubling, up to 256
bytes. Names are 64-bit digests of those pairs, equal wherever equal pairs stand, so refining needs no
exchange; what must meet across the cluster are only the suffixes of a sample.

The sample: of every ``WINDOW`` neighbouring positions the one whose 16-byte bucket has the least name
(a digest, hence in no order that texts prefer) is the anchor. A ``length``-byte string has its
anchor among its first ``WINDOW`` positions and chooses it by its own bytes alone, so equal strings
have equal anchors at equal distances. Strings with the same anchor form a run of starts; the run is
the unit that is exchanged and sorted:

1. Runs are sorted into the buckets of the bytes that all strings of an anchor share, and these are
   refined by sorting on the bucket of the whole stretch that the run's strings cover, which reaches to
   later offsets. Runs that stay together are repeated whole.
2. Runs that agree in the first only (a repeat begins or ends in them) send the bucket of each of
   their strings, one run per distinct stretch, and those strings that meet are repeated.

The runs of each task are refined so among themselves before anything is exchanged: of those that stay
together one stands for all, and of a bucket whose runs differ there a few stay in it while the rest,
which send their strings anyway, are dealt over the cluster. Strings are sorted so, too. So the most
frequent passage, whatever its surroundings, sends a few rows per task into one bucket. Both exchanges
carry names and positions, never texts. Names that decide are pairs of 64-bit digests.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import shared_checkpoint, table

WINDOW = 96
CHUNK = 1 << 21  # bytes refined at once
RUNS = 1 << 20  # runs, or strings, sorted before they are sent
KINDS = 8  # different runs that one sort sends into one bucket
A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def named(left: np.ndarray, right: np.ndarray, seed: int = 0) -> np.ndarray:
    """The name of a pair of names."""
    out = left * A
    out ^= out >> np.uint64(29)
    out += right * B + np.uint64(seed)
    out ^= out >> np.uint64(32)
    out *= A
    out ^= out >> np.uint64(31)
    return out


class Buckets:
    """Bucket names of all positions of a byte buffer, by doubled length; those of 16 and 256 are kept.

    ``at[q][p]`` names the q bytes at p. Positions whose q bytes reach over the end have no entry.
    """

    def __init__(self, data: np.ndarray):
        x = data.astype(np.uint64)
        for width in (1, 2, 4):  # the 8-gram itself is the first identifier
            x = x[:-width] | x[width:] << np.uint64(8 * width)
        self.at = {}
        q = 8
        while q < 256:
            x = named(x[:-q], x[q:])
            q *= 2
            if q in (16, 256):
                self.at[q] = x

    def name(self, p: np.ndarray, length: int, seed: int) -> np.ndarray:
        """The name of ``length`` (256 to 512) bytes at each p: two overlapping buckets of 256."""
        x = self.at[256]
        return named(x[p], x[p + (length - 256)], seed)


def anchors(names: np.ndarray, window: int) -> np.ndarray:
    """For each start, the position in its window whose name is least (the first of equals)."""
    x = names & np.uint64(0xFFFFFFFF00000000) | np.arange(len(names), dtype=np.uint64)
    q = 1
    while 2 * q <= window:
        x = np.minimum(x[:-q], x[q:])
        q *= 2
    if q < window:
        x = np.minimum(x[: len(x) - (window - q)], x[window - q :])
    return (x & np.uint64(0xFFFFFFFF)).astype(np.int64)


def pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, list[tuple[int, int, int, pa.RecordBatch, int]]]]:
    """Buffers of about ``CHUNK`` bytes with the texts in them: (begin, end, offset in text, batch, row).

    A longer text comes in several buffers that overlap by ``length`` - 1 bytes, so that each of its
    strings lies in one buffer exactly.
    """
    parts: list[bytes] = []
    texts: list[tuple[int, int, int, pa.RecordBatch, int]] = []
    size = 0
    for b in batches:
        col = b.column(b.schema.get_field_index("text"))
        for i in range(b.num_rows):
            raw = col[i].as_buffer() if col[i].is_valid else None
            n = raw.size if raw is not None else 0
            if n < length:
                continue
            for a in range(0, n - length + 1, CHUNK):
                part = raw[a : min(n, a + CHUNK + length - 1)]
                if size and size + part.size > CHUNK + length:
                    yield np.frombuffer(b"".join(parts), np.uint8), texts
                    parts, texts, size = [], [], 0
                texts.append((size, size + part.size, a, b, i))
                parts.append(part)
                size += part.size
    if size:
        yield np.frombuffer(b"".join(parts), np.uint8), texts


def refined(row: np.ndarray, place: np.ndarray, shared: np.ndarray, whole: np.ndarray, kinds: int | None = None, names: tuple[str, str, str] = ("place", "shared", "whole")) -> pa.RecordBatch:
    """Runs with the number that each stands for: 1, 2 for more, and 0 for those that another stands for.

    Sorted by bucket, then by the name that refines it, and returned in the given order. A run that another stands for is repeated
    whatever the rest of the corpus holds, so its key is changed to be dealt out by its place.

    Of a bucket with more than ``kinds`` different names only that many stay in it. They show that
    its runs differ, so the others send their strings whatever else is in it: they are dealt out by
    their place, too, with a negative number and their bucket in place of the name.
    """
    order = np.lexsort((whole, shared))
    row, place, shared, whole = row[order], place[order], shared[order], whole[order]
    bucket = np.append(True, shared[1:] != shared[:-1])[: len(row)]
    new = bucket | np.append(True, whole[1:] != whole[:-1])[: len(row)]
    first = np.flatnonzero(new)
    seen = np.zeros(len(row), np.int8)
    seen[first] = np.minimum(np.diff(np.append(first, len(row))), 2)
    dealt = ~new
    if kinds is not None:
        nth = np.cumsum(new)
        begin = np.flatnonzero(bucket)
        sure = new & (nth - np.repeat(nth[begin], np.diff(np.append(begin, len(row)))) >= kinds)
        seen[sure] *= -1
        whole = np.where(sure, shared, whole)
        dealt |= sure
    shared = np.where(dealt, named(row.view(np.uint64), place.view(np.uint64), 5), shared)
    back = np.argsort(order)  # in the order of the texts, in which rows and places compress
    columns = row, place, shared.view(np.int64), whole.view(np.int64), seen
    return pa.RecordBatch.from_arrays([pa.array(c[back]) for c in columns], names=["row", *names, "seen"])


def runs_of(length: int, window: int):
    """row, text -> a row per run: its first start, number of starts and anchor's distance in one, and names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in found(batches):
            held.append(part)
            size += len(part[0])
            if size >= RUNS:
                yield refined(*map(np.concatenate, zip(*held, strict=True)), kinds=KINDS)
                held, size = [], 0
        if held:
            yield refined(*map(np.concatenate, zip(*held, strict=True)), kinds=KINDS)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for data, texts in pieces(batches, length):
            own = Buckets(data)
            anchor = anchors(own.at[16], window)
            begin = np.array([t[0] for t in texts])
            many = np.array([t[1] for t in texts]) - length + 1 - begin  # starts
            doc = np.repeat(np.arange(len(texts)), many)
            start = np.arange(len(doc)) + np.repeat(begin - np.cumsum(many) + many, many)
            at = anchor[start]
            new = np.ones(len(doc), bool)
            new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(doc)))
            lo, a, d = start[first], at[first], doc[first]
            shared = own.name(a, length - window + 1, 1)
            whole = named(own.name(lo, length, 2), own.name(lo + n - 1, length, 3))
            whole = named(whole, ((a - lo) * 256 + n).astype(np.uint64))
            row, offset = np.array([t[3].column(0)[t[4]].as_py() for t in texts]), np.array([t[2] for t in texts])
            place = (lo - begin[d] + offset[d]) << 16 | n << 8 | a - lo
            yield row[d], place, shared, whole

    return run, "row long, place long, shared long, whole long, seen byte"


def probes_of(length: int):
    """row, text, unsettled runs -> a row per start of a string: its name, its anchor's, and the number it stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in found(batches):
            held.append(part)
            size += len(part[0])
            if size >= RUNS:
                yield refined(*map(np.concatenate, zip(*held, strict=True)), names=("lo", "name", "side"))
                held, size = [], 0
        if held:
            yield refined(*map(np.concatenate, zip(*held, strict=True)), names=("lo", "name", "side"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            for i in range(b.num_rows):
                raw = np.frombuffer(b.column(1)[i].as_buffer(), np.uint8)
                place, shared = (b.column(2)[i].values.field(k).to_numpy(zero_copy_only=False) for k in range(2))
                order = np.argsort(place)
                place, shared = place[order], shared[order].view(np.uint64)
                lo, n, dist = place >> 16, place >> 8 & 255, place & 255
                # neighbouring runs share a buffer, distant ones do not, so the work follows the probes
                cut = np.flatnonzero((lo[1:] > lo[:-1] + 4 * length) | (lo[1:] // CHUNK != lo[:-1] // CHUNK)) + 1
                for f, z in zip([0, *cut], [*cut, len(lo)], strict=True):
                    base, k = int(lo[f]), n[f:z]
                    own = Buckets(raw[base : int(lo[z - 1] + n[z - 1]) - 1 + length])
                    step = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    start = np.repeat(lo[f:z], k) + step
                    name = own.name(start - base, length, 4)
                    side = named(np.repeat(shared[f:z], k), (np.repeat(dist[f:z], k) - step).astype(np.uint64))
                    yield np.full(len(start), b.column(0)[i].as_py()), start, name, side

    return run, "row long, lo long, name long, side long, seen byte"


def removed(raw: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[int, int, bytes]:
    """(bytes removed, maximal stretches, the rest) for stretches of [begin, end)."""
    if not len(begin):
        return 0, 0, raw
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.append(True, begin[1:] > end[:-1])
    begin, end = begin[new], end[np.append(np.flatnonzero(new)[1:] - 1, len(end) - 1)]
    kept, at = [], 0
    for x, y in zip(begin.tolist(), end.tolist(), strict=True):
        kept.append(raw[at:x])
        at = y
    return int((end - begin).sum()), len(begin), b"".join([*kept, raw[at:]])


def sorted_runs(own: DataFrame, length: int, window: int) -> DataFrame:
    """row, places of settled runs, and places and names of runs whose strings must be compared."""
    run, schema = runs_of(length, window)
    same, side = Window.partitionBy("shared", "whole"), Window.partitionBy("shared")
    seen = own.mapInArrow(run, schema).repartition("shared").select(
        "*",
        F.sum("seen").over(same).alias("alike"),
        F.min("whole").over(side).alias("low"),
        F.max("whole").over(side).alias("high"),
        F.lag("whole").over(side.orderBy("whole")).alias("before"),
    ).where("seen <= 0 OR alike > 1 OR low <> high")
    # runs that repeat whole are settled; where runs differ, one of each kind sends its strings
    alone = F.col("seen") < 0
    settled = F.col("seen").isin(0, -2) | ~alone & (F.col("alike") > 1)
    sends = alone | (F.col("seen") > 0) & (F.col("low") != F.col("high")) & F.coalesce(F.col("before") != F.col("whole"), F.lit(True))
    seen = seen.withColumn("settled", settled).withColumn("sends", sends).withColumn("shared", F.when(alone, F.col("whole")).otherwise(F.col("shared")))
    return seen.where("settled OR sends").groupBy("row").agg(
        F.collect_list(F.when(F.col("settled"), F.col("place"))).alias("settled"),
        F.collect_list(F.when(F.col("sends"), F.struct("place", "shared"))).alias("sent"),
    )


def file_rows(docs: DataFrame, name: str = "row") -> DataFrame:
    """``docs``, a plain read of Parquet files, with a number per row: its file's among the paths, and its place there.

    The numbers are the same at each read, however the files are split, which follows the cores at hand.
    """
    path = F.col("_metadata.file_path")
    # a row per file, so one task may number them and every task may hold them
    files = docs.select(path.alias("_path")).distinct().select("_path", F.row_number().over(Window.orderBy("_path")).cast("long").alias("_file"))
    place = docs.select("*", path.alias("_path"), F.col("_metadata.row_index").alias("_index"))
    return place.join(F.broadcast(files), "_path").withColumn(name, F.shiftleft("_file", 40).bitwiseOR(F.col("_index"))).drop("_path", "_file", "_index")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, window: int = WINDOW, row_col: str | None = None) -> DataFrame:
    """Remove every byte that a ``length``-byte string covers which starts anywhere else, too.

    Texts are UTF-8 bytes, a null text is empty; strings never cross texts, and all are judged on the
    input. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed stretches), kept_sha256 and
    kept (the remaining bytes). ``length`` may be 256 + ``window`` to 512. A text shorter than
    ``length`` keeps all. Rows that repeat in id and text are copies of each other; null ids stay
    null. An empty table gives no rows; other columns are left out. ``docs`` is read more than once:
    ``row_col`` is a long column that tells its rows apart, alike at each read (see ``file_rows``).
    Without one the rows are numbered and written to the checkpoint folder first.
    """
    if not 256 + window <= length <= 512 or not 16 < window < 256:
        raise ValueError("length must be from 256 + window to 512")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text")
    row = F.monotonically_increasing_id() if row_col is None else F.col(row_col)
    own = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), text)
    if row_col is None:
        own = shared_checkpoint(own)
    found = shared_checkpoint(sorted_runs(own.select("row", "text"), length, window))
    probe, schema = probes_of(length)
    asked = own.join(found.where(F.size("sent") > 0).select("row", "sent"), "row")
    # doc_id goes along, unused, so that both joins read one exchange of the texts
    strings = asked.select("row", "text", "sent", "doc_id").mapInArrow(probe, schema).repartition("name")
    met = strings.select("row", "lo", "seen", F.sum("seen").over(Window.partitionBy("name", "side")).alias("n")).where("seen = 0 OR n > 1")
    starts = met.groupBy("row").agg(F.collect_list("lo").alias("starts"))
    joined = own.join(found.where(F.size("settled") > 0).select("row", "settled"), "row", "left").join(starts, "row", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def of(column: pa.Array, i: int) -> np.ndarray:
            return column[i].values.to_numpy(zero_copy_only=False) if column[i].is_valid else np.empty(0, np.int64)

        for b in batches:
            rows = []
            for i in range(b.num_rows):
                place, start = of(b.column(2), i), of(b.column(3), i)
                begin = np.concatenate([place >> 16, start])
                end = np.concatenate([(place >> 16) + (place >> 8 & 255) - 1, start]) + length
                raw = b.column(1)[i].as_py()
                gone, n, rest = removed(raw, begin, end)
                rows.append((len(raw), gone, n, hashlib.sha256(rest).hexdigest(), rest))
            kinds = pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.select("doc_id", "text", "settled", "starts").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rest comes as text, too: a character that a removal cuts reads as U+FFFD there, not in the digest."""
    found = remove_repeats(file_rows(table(spark, sf_dir, "documents")), row_col="row")
    return found.withColumn("text", F.make_valid_utf8(F.col("kept").cast("string"))).drop("kept")


#: Positions of all 400-byte strings are beyond SQL here: tested against brute force.
ORACLE_SQL = None
