"""Who stood on court at each rally, and what each point of a rotation counts, from a log with substitutions.

Stints: from one substitution of a side to the next its player in is on court; before the first, that one's player out. They are ranges of the
match's row numbers, and rallies find both sides' players by a join on ranges.

Points: the payload tells a side's score after the point. Where that is one more than the score so far the point is normal, where it isn't more the
row is there twice and counts nothing, and where it is more the points between were not logged: they count, but belong to no rally. A row without a
score counts what its strings say, and one that takes a point back lowers the score, to nought at least. Each of these is score -> max(c, score + d),
and such steps join to one of their kind, so the running score is a running sum and a running maximum instead of a loop over rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.operators.joins import in_ranges

#: Rows of a match that share a bucket of the join.
WIDTH = 64


def stints(subs: DataFrame, ends: DataFrame) -> DataFrame:
    """match_id, side, player, low, high, mismatch (the player out was not the one on court). subs: match_id, side, pos, player_in, player_out; ends: match_id, rows."""
    w = Window.partitionBy("match_id", "side").orderBy("pos")
    own = subs.withColumns({"next": F.lead("pos").over(w), "nth": F.row_number().over(w), "was": F.lag("player_in").over(w)}).join(ends, "match_id")
    till = F.coalesce("next", F.col("rows") + 1)
    stint = lambda player, low, high, mismatch: F.struct(player.alias("player"), low.cast("long").alias("low"), high.cast("long").alias("high"), mismatch.alias("mismatch"))
    after = stint(F.col("player_in"), F.col("pos"), till, F.coalesce(F.col("was") != F.col("player_out"), F.lit(False)))
    before = stint(F.col("player_out"), F.lit(0), F.col("pos"), F.lit(False))
    return own.select("match_id", "side", F.inline(F.when(F.col("nth") == 1, F.array(before, after)).otherwise(F.array(after))))


def on_court(rallies: DataFrame, stints: DataFrame, width: int = WIDTH) -> DataFrame:
    """rallies (match_id, pos) with p0 and p1, who stood for each side; rallies of sides without substitutions have nobody there."""
    found = in_ranges(rallies.select("match_id", "pos"), stints.select("match_id", "side", "player", "low", "high"), ["match_id"], "pos", "low", "high", width)
    both = found.groupBy("match_id", "pos").agg(*(F.max(F.when(F.col("side") == s, F.col("player"))).alias(f"p{s}") for s in (0, 1)))
    return rallies.join(both, ["match_id", "pos"], "left")


def scored(points: DataFrame) -> DataFrame:
    """points (match_id, side, pos, delta by strings, end by payload or null) with the side's score before and after, what the row is, and the points it shows were not logged."""
    by_end = (F.col("delta") >= 0) & F.col("end").isNotNull()
    w = Window.partitionBy("match_id", "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    steps = points.withColumns({"d": F.when(by_end, 0).otherwise(F.col("delta")), "c": F.when(by_end, F.col("end")).when(F.col("delta") < 0, 0)})
    steps = steps.withColumn("sum", F.sum("d").over(w)).withColumn("least", F.col("c") - F.col("sum"))
    steps = steps.withColumn("after", (F.col("sum") + F.greatest(F.lit(0), F.coalesce(F.max("least").over(w), F.lit(0)))).cast("long"))
    steps = steps.withColumn("before", F.coalesce(F.lag("after").over(Window.partitionBy("match_id", "side").orderBy("pos")), F.lit(0)))
    what = (
        F.when(F.col("delta") < 0, "taken back").when(F.col("end").isNull(), F.when(F.col("delta") > 0, "told").otherwise("nothing"))
        .when(F.col("end") == F.col("before") + 1, "normal").when(F.col("end") <= F.col("before"), "twice").otherwise("gap")
    )
    return steps.withColumn("what", what).withColumn("gap", F.when(F.col("what") == "gap", F.col("end") - F.col("before") - 1).otherwise(0).cast("long")).drop("d", "c", "sum", "least")


def attributed(rows: DataFrame, subs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Points with the players of the rally they ended: p0 and p1 of the last rally row, unless a counted point has had it or there is none.

    rows: match_id, pos (1, 2, ... in a match), kind (rally, point or other), side, delta, end, log_index.
    """
    ends = rows.groupBy("match_id").agg(F.max("pos").alias("rows"))
    court = on_court(rows.where("kind = 'rally'").select("match_id", "pos"), stints(subs, ends), width)
    points = scored(rows.where("kind = 'point'").select("match_id", "side", "pos", "delta", "end", "log_index"))
    counts = F.col("what").isin("normal", "gap", "told")
    line = points.select("match_id", "pos", F.lit("point").alias("kind"), counts.alias("counts")).unionByName(rows.where("kind = 'rally'").select("match_id", "pos", "kind", F.lit(False).alias("counts")))
    w = Window.partitionBy("match_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = line.withColumns({"rally": F.max(F.when(F.col("kind") == "rally", F.col("pos"))).over(w), "taken": F.max(F.when(F.col("counts"), F.col("pos"))).over(w)}).where("kind = 'point'")
    open_rally = F.when(F.col("counts") & (F.col("rally") > F.coalesce("taken", F.lit(0))), F.col("rally"))
    pinned = points.join(last.select("match_id", "pos", open_rally.alias("rally")), ["match_id", "pos"])
    return pinned.join(court.select("match_id", F.col("pos").alias("rally"), "p0", "p1"), ["match_id", "rally"], "left")
