"""Connected components of an edge table, by minimum labels with pointer jumping."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.sources.storage import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of any orderable type -> (node, component): the least node it is connected with.

    Each pass takes the least label among a node and its neighbours, then the label of that label; the passes are about
    as many as the logarithm of the longest chain. Labels are kept in the shared folder between passes. A hot node's
    labels are reduced before they are shuffled, and its joins are plain ones that Spark can split.
    """
    spark, own, old = edges.sparkSession, [], []
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), "edges", own)
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component")), "labels", old)
    while True:
        heard = both.join(labels.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.min("component").alias("heard"))
        nearer = labels.join(heard, "node").select("node", "component", F.least("component", "heard").alias("m"))
        up = labels.select(F.col("node").alias("m"), F.col("component").alias("up"))
        now: list[str] = []
        jumped = written(nearer.join(up, "m", "left").select("node", "component", F.least("m", F.coalesce("up", "m")).alias("m")), "labels", now)
        done = jumped.where("m <> component").isEmpty()
        discard(spark, old)
        old = now
        labels = jumped.select("node", F.col("m").alias("component"))
        if done:
            discard(spark, own)
            return labels
