"""Exact dedup: a tree merge of sorted digest runs.

Every input partition makes a run: one entry per distinct digest with the best id and the number of
rows. The runs are the leaves of a binomial tree: in each round two neighbours (``fan``, if more are to
meet) send theirs to one task per slice of the digest space, which merges them in digest order and again
reduces them to one entry per digest. The blocks a task reads are sorted already, one per sender, and
the sorter merges such stretches rather than sorting afresh. A text that a third of all rows share
therefore sends at most one entry per run and slice, and no task sees more than the entries of its
slice. Entries carry the SHA-256, the length and an independent 64-bit hash, all of which must agree
before two entries count as the same text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import NO_ID, shared_checkpoint, table

KEY_BYTES = 48
RUN_SCHEMA = "slice int, run int, entry binary, keep_id long, keep_row long, group_size long"


def merge_runs(largest: bool):
    """A function that reduces a sorted stream of entries to one per (slice, run, entry)."""

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = batch.schema
            entry = batch.column("entry").cast(pa.binary())
            start = int.from_bytes(entry.buffers()[1][4 * entry.offset : 4 * entry.offset + 4], "little")
            raw = np.frombuffer(entry.buffers()[2], np.uint8, KEY_BYTES * len(entry), start).reshape(-1, KEY_BYTES)
            cols = [raw] + [batch.column(c).to_numpy(zero_copy_only=False) for c in ("slice", "run", "keep_id", "keep_row", "group_size")]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            key, part, run, keep, row, n = cols
            new = np.ones(len(n), bool)
            new[1:] = (key[1:] != key[:-1]).any(axis=1) | (run[1:] != run[:-1]) | (part[1:] != part[:-1])
            at = np.flatnonzero(new)
            # the best of each group: by id, then by row
            group = np.cumsum(new) - 1
            order = np.lexsort((row, keep, group) if largest else (-row, -keep, group))
            best = order[np.append(at[1:], len(n)) - 1]
            cols = [key[at], part[at], run[at], keep[best], row[best], np.add.reduceat(n, at)]
            held = [c[-1:] for c in cols]
            if len(at) > 1:
                yield out([c[:-1] for c in cols], schema)
        if held is not None:
            yield out(held, schema)

    def out(cols: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
        key, part, run, keep, row, n = cols
        entry = pa.FixedSizeBinaryArray.from_buffers(pa.binary(KEY_BYTES), len(n), [None, pa.py_buffer(np.ascontiguousarray(key))])
        made = {"slice": pa.array(part, pa.int32()), "run": pa.array(run, pa.int32()), "entry": entry.cast(pa.binary()), "keep_id": pa.array(keep, pa.int64()), "keep_row": pa.array(row, pa.int64()), "group_size": pa.array(n, pa.int64())}
        return pa.RecordBatch.from_arrays([made[f.name] for f in schema], names=[f.name for f in schema])

    return merged


def tree_merge(entries: DataFrame, keep: str = "max", runs: int = 64, fan: int = 2, slices: int | None = None) -> DataFrame:
    """One row per distinct entry: entry, keep_id, keep_row, group_size.

    ``entries`` has (entry, id, row); ``runs`` is the number of leaves of the merge tree and ``fan``
    how many runs meet in a round. ``slices`` cuts the digest space (default: the session's shuffle
    partitions), so the last round still has that many tasks.
    """
    slices = slices or int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    level = entries.select(
        F.pmod(F.conv(F.hex(F.substring("entry", 1, 4)), 16, 10).cast("long"), F.lit(slices)).cast("int").alias("slice"),
        F.pmod(F.spark_partition_id(), F.lit(runs)).alias("run"),
        "entry",
        F.col("id").alias("keep_id"),
        F.col("row").alias("keep_row"),
        F.lit(1).cast("long").alias("group_size"),
    )
    merge = merge_runs(keep == "max")
    level = level.sortWithinPartitions("slice", "run", "entry").mapInArrow(merge, RUN_SCHEMA)
    left = runs
    while left > 1:
        left = -(-left // fan)
        level = level.withColumn("run", F.floor(F.col("run") / fan).cast("int"))
        level = level.repartition(slices, "slice", "run").sortWithinPartitions("slice", "run", "entry").mapInArrow(merge, RUN_SCHEMA)
    return level.select("entry", "keep_id", "keep_row", "group_size")


def entries_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, text_sha256, entry) of every row; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    sha = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), F.length(text).cast("long").alias("_n"), F.xxhash64(text).alias("_x"))
    return sha.select("row", "doc_id", "text_sha256", F.concat(F.unhex("text_sha256"), F.unhex(F.lpad(F.hex("_n"), 16, "0")), F.unhex(F.lpad(F.hex("_x"), 16, "0"))).alias("entry"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", runs: int = 64, fan: int = 2) -> DataFrame:
    """Decide for every row of ``docs`` whether it stays.

    Returns row, doc_id, keep_id, group_size, kept, text_sha256; other input columns are left out, so
    their names cannot clash. ``keep`` is "max" or "min": the id that stays among equal texts. A null
    text counts as empty; a null id loses against any other id and is returned as null. Rows with
    the same id and text are one group of which a single row stays. An empty table gives no rows.
    """
    rows = shared_checkpoint(entries_of(docs, id_col, text_col))
    lost = NO_ID if keep == "max" else 2**63 - 1
    best = tree_merge(rows.select("entry", F.coalesce("doc_id", F.lit(lost)).alias("id"), "row"), keep, runs, fan)
    joined = rows.join(best.where("group_size > 1"), "entry", "left")
    return joined.select(
        "row",
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.nullif("keep_id", F.lit(lost))).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that stay, with their own columns. ``docs`` must be a table that rereads alike."""
    lost = exact_dedup(docs).where("NOT kept").select(F.col("row").alias("_row"))
    return docs.withColumn("_row", F.monotonically_increasing_id()).join(lost, "_row", "left_anti").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("row")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
