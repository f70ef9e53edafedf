"""Unions of ranges, over rows and over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_rows(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys, start, end of the maximal ranges that the rows cover; touching ranges join, empty ones vanish."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    own = df.where(F.col(end) > F.col(start)).select(*keys, F.col(start).alias("_s"), F.col(end).alias("_e"))
    w = Window.partitionBy(*keys).orderBy("_s", "_e")
    reach = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("_new", F.coalesce((F.col("_s") > reach).cast("int"), F.lit(1)))
    own = own.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return own.groupBy(*keys, "_island").agg(F.min("_s").alias(start), F.max("_e").alias(end)).drop("_island")


def covered(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """keys and the length of the union of the rows' ranges."""
    return union_rows(df, keys, start, end).groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).cast("long").alias("covered"))


RANGES = "array<struct<s:int,e:int>>"


def merge_ranges(ranges: Column, most: Column) -> Column:
    """An array of ranges cut to [0, most], without empty ones, sorted, and merged where they touch."""
    cut = F.transform(ranges, lambda r: F.struct(F.greatest(F.lit(0), F.least(r["s"], most)).alias("s"), F.greatest(F.lit(0), F.least(r["e"], most)).alias("e")))
    ordered = F.array_sort(F.filter(cut, lambda r: r["e"] > r["s"]))

    def add(out: Column, r: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["s"].alias("s"), F.greatest(last["e"], r["e"]).alias("e"))))
        return F.when(F.size(out) == 0, F.array(r)).when(r["s"] <= F.try_element_at(out, F.lit(-1))["e"], joined).otherwise(F.concat(out, F.array(r)))

    return F.aggregate(ordered, F.array().cast(RANGES), add)


def ranges_length(ranges: Column) -> Column:
    return F.aggregate(ranges, F.lit(0), lambda a, r: a + r["e"] - r["s"])
