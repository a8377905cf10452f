"""Referees' logs, read from `events`: four users are a match, two a side; and what the archive says of the same matches.

Rows have the reference shape: log type, server and receiver, the score strings before and after (server's, receiver's, server number), and the payload
of a point (team, its score before and after). Corrections, stale strings, late openings and unreadable strings come up by the row's key.
LOGS and ARCHIVE are the same definitions as SQL, for the oracles.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.sources.tables import LOG_TYPES, table

#: Log types of an opened rally, a point, a side-out and a second server.
RALLY, POINT, SIDEOUT, SECOND = 12, 14, 16, 23


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.create_map(*(F.lit(x) for pair in LOG_TYPES.items() for x in pair))
    k, s0 = F.col("k"), F.col("event_id") % 9
    late = F.when(k % 13 == 0, 2).otherwise(0)
    moved = F.when(k % 6 == 0, 0).when(k % 6 == 5, -1).otherwise(1)
    text = lambda first: F.when(k % 19 == 0, F.lit("x-y")).otherwise(F.concat_ws("-", first, F.floor(F.col("event_id") / 9) % 9, 1 + F.col("event_id") % 2))
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    point = F.col("event_type") == "click"
    return e.select(
        F.floor(F.col("user_id") / 4).cast("long").alias("match_id"), F.col("event_id").alias("log_index"), "k", kind[F.col("event_type")].alias("log_type"),
        (F.lit(1) + F.floor(F.col("event_id") / 100) % 60).cast("int").alias("game_number"), F.concat(F.lit("P"), F.col("user_id").cast("string")).alias("server_uuid"),
        F.concat(F.lit("P"), (F.col("user_id") + F.when(F.col("user_id") % 4 < 2, 2).otherwise(-2)).cast("string")).alias("receiver_uuid"), F.floor(F.col("user_id") % 4 / 2).cast("int").alias("server_side"),
        text(s0).alias("start_string"), text(s0 + moved).alias("end_string"),
        F.when(point & (k % 17 != 0), F.concat(F.lit("T"), F.floor(F.col("user_id") / 4).cast("string"), F.lit("-"), F.floor(F.col("user_id") % 4 / 2).cast("string"))).alias("team_uuid"),
        F.when(point & (k % 7 != 0) & (k % 11 != 0), s0 + late).cast("int").alias("point_start"),
        F.when(point & (k % 7 != 0), s0 + late + F.when(k % 6 == 5, -1).otherwise(1)).cast("int").alias("point_end"))


LOGS = """
ev as (select *, cast(json_extract_string(props, '$.k') as int) k from events),
logs as (select user_id // 4 match_id, event_id log_index, case event_type when 'view' then 12 when 'click' then 14 when 'purchase' then 16 when 'signup' then 23 when 'error' then 22 end log_type,
    cast(1 + (event_id // 100) % 60 as int) game_number, 'P' || user_id server_uuid, 'P' || (user_id + case when user_id % 4 < 2 then 2 else -2 end) receiver_uuid, cast((user_id % 4) // 2 as int) server_side,
    case when k % 19 = 0 then 'x-y' else (event_id % 9) || '-' || ((event_id // 9) % 9) || '-' || (1 + event_id % 2) end start_string,
    case when k % 19 = 0 then 'x-y' else (event_id % 9 + case when k % 6 = 0 then 0 when k % 6 = 5 then -1 else 1 end) || '-' || ((event_id // 9) % 9) || '-' || (1 + event_id % 2) end end_string,
    case when event_type = 'click' and k % 17 <> 0 then 'T' || (user_id // 4) || '-' || ((user_id % 4) // 2) end team_uuid,
    cast(case when event_type = 'click' and k % 7 <> 0 and k % 11 <> 0 then event_id % 9 + case when k % 13 = 0 then 2 else 0 end end as int) point_start,
    cast(case when event_type = 'click' and k % 7 <> 0 then event_id % 9 + case when k % 13 = 0 then 2 else 0 end + case when k % 6 = 5 then -1 else 1 end end as int) point_end from ev)
"""


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, discipline, tour, and the archived games (null where it has none); the regions stand for matches whose log is empty or not there."""
    own = log_rows(spark, sf_dir)
    score = own.groupBy("match_id", "game_number").agg(*(F.count_if((F.col("log_type") == POINT) & (F.col("server_side") == s)).cast("int").alias(f"s{s}") for s in (0, 1)))
    games = score.groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("game_number", F.struct("s0", "s1")))).alias("games"))
    known = games.select("match_id", F.when(F.col("match_id") % 23 != 0, F.col("games")).alias("games"), F.lit(None).cast("string").alias("log_status"))
    bare = table(spark, sf_dir, "region").select((F.lit(-1) - F.col("r_regionkey")).cast("long").alias("match_id"), F.lit(None).cast(games.schema["games"].dataType).alias("games"), F.when(F.col("r_regionkey") % 2 == 0, "empty").otherwise("404").alias("log_status"))
    return known.unionByName(bare).select("*", F.when(F.col("match_id") % 3 == 0, "singles").otherwise("doubles").alias("discipline"), F.when(F.col("match_id") % 2 == 0, "MLP").otherwise("PPA").alias("tour"))
