"""Unions, intersections and runs of half-open ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """Ranges (keys, start, end) merged where they overlap or meet; empty ones are dropped."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = ranges.where("start < end").withColumn("_new", F.coalesce((F.col("start") > reached).cast("int"), F.lit(1)))
    numbered = flagged.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def clamped(ranges: DataFrame, length: str) -> DataFrame:
    """Ranges cut to a text's length, given as a column."""
    return ranges.withColumn("start", F.least("start", length)).withColumn("end", F.least("end", length))


def intersect_ranges(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """The parts that both of two relations of disjoint ranges cover."""
    joined = a.alias("a").join(b.alias("b"), keys).where("a.start < b.end AND b.start < a.end")
    return joined.select(*keys, F.greatest("a.start", "b.start").alias("start"), F.least("a.end", "b.end").alias("end"))


def runs(flags: DataFrame, keys: list[str], place: str, flag: str) -> DataFrame:
    """(keys, start, end) of each run of true flags in the order of ``place``, a whole number without gaps."""
    order = Window.partitionBy(*keys).orderBy(place)
    numbered = flags.withColumn("_n", F.row_number().over(order)).where(F.col(flag)).withColumn("_run", F.col(place) - F.row_number().over(order))
    return numbered.groupBy(*keys, "_run").agg(F.min(place).alias("start"), (F.max(place) + 1).alias("end")).drop("_run")


def array_union(ranges: Column) -> Column:
    """The same as ``union_ranges`` for an array of structs (start, end)."""
    sorted_ = F.array_sort(F.filter(ranges, lambda r: r["start"] < r["end"]))
    empty = F.array().cast("array<struct<start: int, end: int>>")

    def step(out: Column, r: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        joined = F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], r["end"]).alias("end"))))
        return F.when(F.coalesce(r["start"] <= last["end"], F.lit(False)), joined).otherwise(F.concat(out, F.array(F.struct(r["start"].alias("start"), r["end"].alias("end")))))

    return F.aggregate(sorted_, empty, step)
