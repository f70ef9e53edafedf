"""Which of many short texts stand in a longer text of the same key."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Letters of the patterns that one automaton holds, and patterns that meet a text in one task.
LETTERS, PATTERNS = 1 << 20, 1 << 12
_KINDS = [("_key", "long"), ("_part", "int"), ("_side", "int"), ("_text", "string")]


def found_in(patterns: set[str], text: str) -> set[str]:
    """Those of the patterns that the text contains: one pass of an automaton of them all."""
    if len(patterns) < 8:
        return {p for p in patterns if p in text}
    automaton = ahocorasick.Automaton()
    for p in patterns:
        automaton.add_word(p, p)
    automaton.make_automaton()
    return {p for _, p in automaton.iter(text)}


def contained(rows: DataFrame, texts: DataFrame, keys: list[str], pattern: str, text: str) -> DataFrame:
    """The rows whose pattern stands in a text with the same keys.

    ``texts`` has one row per key. Patterns of a key that has very many are dealt over parts, and the text is
    copied to each part, not to each pattern; a task holds one text and one automaton of bounded
    size. Null keys equal each other; null or empty patterns, and patterns without a text, are not contained.
    """
    digest = lambda df: df.withColumn("_key", F.xxhash64(*keys))
    own = digest(rows.where(F.length(pattern) > 0))
    many = own.groupBy("_key").agg(F.ceil(F.count("*") / PATTERNS).cast("int").alias("_parts"))
    own = own.join(many, "_key").withColumn("_part", F.pmod(F.xxhash64(pattern), F.col("_parts")).cast("int"))
    whole = F.struct(*[F.col(k) for k in keys])
    payload = own.select("_key", "_part", F.lit(1).alias("_side"), F.col(pattern).alias("_text"), whole.alias("_name"), F.struct(*rows.columns).alias("_row"))
    there = digest(texts).join(many, "_key").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    there = there.select("_key", "_part", F.lit(0).alias("_side"), F.col(text).alias("_text"), whole.alias("_name"), F.lit(None).cast(payload.schema["_row"].dataType).alias("_row"))
    both = there.unionByName(payload)
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartition(parts, "_key", "_part").sortWithinPartitions("_key", "_part", "_name", "_side")
    names = [n for n, _ in _KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, text = None, None
        for b in batches:
            key = list(zip(b.column("_key").to_pylist(), b.column("_part").to_pylist(), b.column("_name").to_pylist(), strict=True))
            side, said = b.column("_side").to_pylist(), b.column("_text").to_pylist()
            i, hits = 0, []
            while i < b.num_rows:
                if side[i] == 0:
                    at, text = key[i], said[i]
                    i += 1
                    continue
                j, letters = i, 0
                while j < b.num_rows and side[j] == 1 and key[j] == key[i] and letters < LETTERS:
                    letters += len(said[j])
                    j += 1
                if key[i] == at and text:
                    known = found_in(set(said[i:j]), text)
                    hits += [k for k in range(i, j) if said[k] in known]
                i = j
            if hits:
                yield b.select(["_row"]).take(pa.array(hits, pa.int64()))

    kind = payload.schema["_row"].dataType.simpleString()
    return both.select(*names, "_name", "_row").mapInArrow(run, f"_row {kind}").select("_row.*")
