"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null id inside an operator; it loses against every real id.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of the data folder, read through Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder, its lineage cut.

    The folder is the one in spark.checkpoint.dir, which all executors share. Only where that
    setting is absent and all tasks run in this process (tests) a temporary folder is set; on a cluster
    its absence is an error.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", "") and spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def split_join(rows: DataFrame, per_key: DataFrame, key: str, count: str, salt: Column, parts: int = 512) -> DataFrame:
    """``rows`` joined with ``per_key`` on ``key``, whatever share of the rows one key holds.

    ``per_key`` is a table with a row per key; its ``count`` says in proportion how many rows a key has.
    A key with more than one ``parts``-th of the sum is split: its rows are dealt over parts by
    ``salt``, a hash of what tells them apart, and its row of ``per_key`` is copied to each part. Fewer
    than ``parts`` keys can be so large, which bounds the broadcast table of their names. Keys must not
    be null.
    """
    most = (per_key.agg(F.sum(count)).first()[0] or 0) / parts
    large = F.broadcast(per_key.where(F.col(count) > most).select(key, F.ceil(F.col(count) / F.lit(max(most, 1.0))).cast("int").alias("_parts")))
    dealt = rows.join(large, key, "left").withColumn("_part", F.pmod(salt, F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    copied = per_key.join(large, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"]).drop("_part")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest reachable node for every node that has an edge.

    ``edges`` has two long columns ``u`` and ``v``. Alternates large-star and small-star rounds;
    the edge set after each round is checkpointed, so a round never replays the ones before it.
    Only minima per node are aggregated, so a node with very many links costs no more than its
    links. Returns (node, component); an empty edge table gives an empty result. Nulls are ignored.
    """
    edges = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    e = shared_checkpoint(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = pairs.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = shared_checkpoint(small.distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
