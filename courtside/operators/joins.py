"""Joins that Spark has no word for, made of those that it has."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of_backward(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the value of the latest right row of its key at or before it (null if none).

    One shuffle by key: both sides are put on one time line, and the last value is carried forward. right is unique by (key, at).
    """
    row = F.struct(*left.columns)
    line = left.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_s"), row.alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v")).unionByName(
        right.select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(0).alias("_s"), F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType).alias("_row"), F.col(value).alias("_v")))
    carried = F.last("_v", ignorenulls=True).over(Window.partitionBy("_k").orderBy("_t", "_s").rowsBetween(Window.unboundedPreceding, 0))
    return line.withColumn("_last", carried).where("_s = 1").select("_row.*", F.col("_last").alias(value))


def as_of_clamped(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with the value at exactly its time; before the key's first time its first value, otherwise its last. Keys without values go."""
    ends = right.groupBy(key).agg(F.min(at).alias("_lo"), F.min_by(value, at).alias("_first"), F.max_by(value, at).alias("_last"))
    exact = right.select(key, at, F.col(value).alias("_exact"))
    found = left.join(ends, key).join(exact, [key, at], "left")
    return found.withColumn(value, F.coalesce("_exact", F.when(F.col(at) < F.col("_lo"), F.col("_first")).otherwise(F.col("_last")))).drop("_lo", "_first", "_last", "_exact")


def self_join_other_side(df: DataFrame, key: str, side: str, other: dict[str, str]) -> DataFrame:
    """Each row beside the rows of its key on another side, whose columns get new names."""
    there = df.select(key, F.col(side).alias("_side"), *(F.col(a).alias(b) for a, b in other.items()))
    return df.join(there, key).where(F.col(side) != F.col("_side")).drop("_side")


def in_ranges(points: DataFrame, ranges: DataFrame, keys: list[str], at: str, low: str, high: str, width: int) -> DataFrame:
    """points with the ranges of their keys that hold them (low <= at < high).

    Both sides are dealt to buckets of `width` on the axis of `at`, so a point meets the ranges of its own bucket alone, and a
    key with many rows is many buckets. A range takes as many rows as the buckets that it covers. Columns besides keys have different names.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    spread = ranges.where(F.col(high) > F.col(low)).withColumn("_bucket", F.explode(F.sequence(bucket(low), F.floor((F.col(high) - 1) / width).cast("long"))))
    met = points.withColumn("_bucket", bucket(at)).join(spread, [*keys, "_bucket"])
    return met.where((F.col(low) <= F.col(at)) & (F.col(at) < F.col(high))).drop("_bucket")
