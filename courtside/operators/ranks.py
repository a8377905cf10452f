"""Numbers over a whole table without one task that sorts it all."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.sources.storage import written


def ranked(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with their place from 1 in the given order, which ends in a unique key.

    Rows are split by ranges of the order and numbered within each; a range's first number is the sum of the counts of those before it, a table of a
    row a range. The ranges are written first, as two plans that each sampled them anew might not agree.
    """
    own = Window.partitionBy("_range").orderBy(*order)
    ranges = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranges.groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("_range", before.alias("_before"))
    return ranges.join(F.broadcast(offsets), "_range").withColumn(name, (F.row_number().over(own) + F.col("_before")).cast("long")).drop("_range", "_before")


def ranked_within(rows: DataFrame, keys: list[str], order: list[str], name: str, size: str | None = None) -> DataFrame:
    """rows with their place from 1 among those of their keys, and how many these are (size); a key may have any share of the rows, as places come from ranked()."""
    placed = written(ranked(rows, [*keys, *order], "_place"), "places")
    own = placed.groupBy(*keys).agg(F.min("_place").alias("_first"), F.count("*").alias(size or "_size"))
    out = placed.join(own, keys).withColumn(name, F.col("_place") - F.col("_first") + 1).drop("_place", "_first")
    return out if size else out.drop("_size")
