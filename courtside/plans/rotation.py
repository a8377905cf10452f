"""Players on court and points of a rotation, from the referees' logs with substitutions."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.operators import rotation
from courtside.registry import query
from courtside.sources.logs import POINT, RALLY, log_rows
from courtside.sources.storage import written

#: Fixed value: log type of a substitution.
SUB = 22

_ROWS = """
ev as (select *, cast(json_extract_string(props, '$.k') as int) k from events),
rw as (select user_id // 4 match_id, event_id log_index, user_id, cast((user_id % 4) // 2 as int) side, case event_type when 'view' then 'rally' when 'click' then 'point' when 'error' then 'sub' else 'other' end kind,
    case when k % 6 = 0 then 0 when k % 6 = 5 then -1 else 1 end delta, case when k % 7 <> 0 then 1 + (event_id // 400) % 25 end "end", row_number() over (partition by user_id // 4 order by event_id) pos from ev),
sb as (select match_id, side, pos, 'P' || user_id player_in, 'P' || (user_id // 2 * 2 + 1 - user_id % 2) player_out from rw where kind = 'sub'),
st as (select match_id, side, pos low, player_in player, lag(player_in) over w <> player_out mismatch from sb window w as (partition by match_id, side order by pos)),
fs as (select match_id, side, 0 low, arg_min(player_out, pos) player, false mismatch from sb group by all), stints as (select * from fs union all select match_id, side, low, player, coalesce(mismatch, false) from st)"""


def _rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(rows, subs): a match's log in order, and its substitutions: the side's two players stand in for each other."""
    rows = log_rows(spark, sf_dir).select("match_id", "log_index", F.col("server_side").alias("side"), F.col("server_uuid").alias("player"), F.when(F.col("log_type") == RALLY, "rally").when(F.col("log_type") == POINT, "point").when(F.col("log_type") == SUB, "sub").otherwise("other").alias("kind"), "k")
    number = F.substring("player", 2, 18).cast("long")
    partner = F.concat(F.lit("P"), (F.floor(number / 2) * 2 + 1 - number % 2).cast("string"))
    rows = rows.withColumns({
        "delta": F.when(F.col("k") % 6 == 0, 0).when(F.col("k") % 6 == 5, -1).otherwise(1), "end": F.when(F.col("k") % 7 != 0, 1 + F.floor(F.col("log_index") / 400) % 25),
        "pos": F.row_number().over(Window.partitionBy("match_id").orderBy("log_index")).cast("long"), "player_out": partner})
    rows = written(rows, "rotation")
    return rows, rows.where("kind = 'sub'").select("match_id", "side", "pos", F.col("player").alias("player_in"), "player_out")


@query(f"""with {_ROWS}, r as (select match_id, log_index, pos from rw where kind = 'rally'),
a as (select r.*, s.player from r asof join (select * from stints where side = 0) s on r.match_id = s.match_id and r.pos >= s.low), b as (select r.log_index, s.player from r asof join (select * from stints where side = 1) s on r.match_id = s.match_id and r.pos >= s.low)
select r.match_id, r.log_index, a.player p0, b.player p1 from r left join a using (log_index) left join b using (log_index)""", match_id="bigint")
def rally_players(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who stood on court for each side at each rally."""
    rows, subs = _rows(spark, sf_dir)
    ends = rows.groupBy("match_id").agg(F.max("pos").alias("rows"))
    court = rotation.on_court(rows.where("kind = 'rally'").select("match_id", "log_index", "pos"), rotation.stints(subs, ends))
    return court.select("match_id", "log_index", "p0", "p1")


@query(f"""with {_ROWS}, s as (select match_id, side, player, low, coalesce(lead(low) over (partition by match_id, side order by low), n + 1) high, mismatch from stints join (select match_id, max(pos) n from rw group by match_id) using (match_id))
select match_id, side, player, low, high - low "rows", mismatch from s where high > low""", match_id="bigint", low="bigint", rows="bigint")
def stint_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players' stints, how many log rows they lasted, and whether the substitution fits who was on court."""
    rows, subs = _rows(spark, sf_dir)
    found = rotation.stints(subs, rows.groupBy("match_id").agg(F.max("pos").alias("rows")))
    return found.where("high > low").select("match_id", "side", "player", "low", (F.col("high") - F.col("low")).alias("rows"), "mismatch")


@query(None)
def rotation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each logged point counts, and who played the rally that it ended."""
    rows, subs = _rows(spark, sf_dir)
    return rotation.attributed(rows, subs).select("match_id", "side", "log_index", "what", "before", "after", "gap", "p0", "p1")
