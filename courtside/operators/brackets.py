"""Seeded brackets of any size: chances to come through each round, byes included."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.functions.probability import sigmoid
from courtside.sources.storage import written


def spot_of(seed: Column, rounds: Column, most: int) -> Column:
    """Where a seed stands among 2 ** rounds places, so that the best meet last: each doubling puts beside seed s the one that makes the sum of the new size and 1."""
    spot, seed, rounds = F.lit(0), seed.cast("long"), rounds.cast("long")
    # from the last doubling back: the partner of a seed of the upper half is in the lower one and stands left of it
    side = []
    s = seed
    for k in range(most, 0, -1):
        size = F.lit(1 << k)
        upper = (rounds >= k) & (s > size / 2)
        side.append((k, upper))
        s = F.when(upper, size + 1 - s).otherwise(s)
    for k, upper in reversed(side):
        spot = F.when(rounds >= k, spot * 2 + upper.cast("long")).otherwise(spot)
    return spot.cast("long")


def bracket(entrants: DataFrame) -> DataFrame:
    """pool, id, round (1: the first), through: the chance to come through it. entrants: pool, id, v (a logit), seed (1, 2, ... in a pool).

    A pool's places are the next power of two; who meets nobody in a round goes on for sure. Each round joins who is left with the other half of
    their part of the bracket, a pool and part being a key.
    """
    sizes = entrants.groupBy("pool").agg(F.greatest(F.ceil(F.log2(F.count("*").cast("double"))), F.lit(0)).cast("int").alias("rounds"))
    most = sizes.agg(F.max("rounds")).first()[0] or 0
    at = entrants.join(sizes, "pool").withColumn("spot", spot_of(F.col("seed"), F.col("rounds"), most)).select("pool", "id", "v", "rounds", "spot", F.lit(1.0).alias("p"))
    at, out = written(at, "bracket"), None
    for k in range(most):
        half = F.shiftright("spot", k)
        others = at.select("pool", half.bitwiseXOR(F.lit(1).cast("long")).alias("half"), F.col("v").alias("v2"), F.col("p").alias("p2"))
        met = at.where(F.col("rounds") > k).withColumn("half", half).join(others, ["pool", "half"], "left")
        at = met.groupBy("pool", "id", "v", "rounds", "spot").agg(F.first("p").alias("was"), F.sum(F.col("p2") * sigmoid(F.col("v") - F.col("v2"))).alias("beat"))
        at = written(at.select("pool", "id", "v", "rounds", "spot", (F.col("was") * F.coalesce("beat", F.lit(1.0))).alias("p")), "bracket")
        done = at.select("pool", "id", F.lit(k + 1).alias("round"), F.col("p").alias("through"))
        out = done if out is None else out.unionByName(done)
    return out if out is not None else at.select("pool", "id", F.lit(0).alias("round"), F.col("p").alias("through")).limit(0)
