"""The walk through referees' logs: points and their corrections, rallies with the score they began at, serving states, and summaries of matches.

All of it is windows over a match's rows in log order, so nothing is folded in Python and a long log is split from the others only by its match.
"""
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.registry import query
from courtside.sources.logs import LOGS, POINT, RALLY, SECOND, SIDEOUT, archive, log_rows



def _later(*keys: str):
    """All later rows, as rows before in the reversed order: one pass, where a frame to the end would be read again for each row."""
    return Window.partitionBy(*keys).orderBy(F.desc("log_index")).rowsBetween(Window.unboundedPreceding, -1)


def _part(text: str, n: int) -> Column:
    return F.try_element_at(F.split(text, "-"), F.lit(n)).try_cast("int")


def point_delta() -> Column:
    """The score change of a point row, from its payload and its strings: where both are there and differ, the smaller one, of equals the strings'."""
    payload = F.col("point_end") - F.coalesce("point_start", F.col("point_end") - 1)
    string = _part("end_string", 1) - _part("start_string", 1)
    return F.when(payload.isNull(), F.coalesce(string, F.lit(0))).when(string.isNull(), payload).when(F.abs(string) <= F.abs(payload), string).otherwise(payload)


_DELTA = """
d as (select *, try_cast(split_part(start_string, '-', 1) as int) a0, try_cast(split_part(end_string, '-', 1) as int) e0, point_end - coalesce(point_start, point_end - 1) pd, regexp_matches(start_string, '^[0-9]+(-[0-9]+)+$') readable from logs),
pt as (select *, case when log_type <> 14 then null when pd is null then coalesce(e0 - a0, 0) when e0 - a0 is null then pd when abs(e0 - a0) <= abs(pd) then e0 - a0 else pd end raw from d)
"""


@query(f"with {LOGS}, {_DELTA} select match_id, log_index, raw delta from pt where log_type = 14", delta="int")
def log_point_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_rows(spark, sf_dir).where(F.col("log_type") == POINT).select("match_id", "log_index", point_delta().alias("delta"))


def _sided(rows: DataFrame) -> DataFrame:
    """Team -> side, learned from the first normal point of each team in log order."""
    good = rows.where((F.col("log_type") == POINT) & F.col("team_uuid").isNotNull() & (point_delta() > 0))
    return good.groupBy("match_id", F.lower("team_uuid").alias("team")).agg(F.min_by("server_side", "log_index").alias("team_side"))


_SIDES = "sides as (select match_id, lower(team_uuid) team, arg_min(server_side, log_index) team_side from pt where raw > 0 and team_uuid is not null group by all)"


@query(f"with {LOGS}, {_DELTA}, {_SIDES} select * from sides")
def log_side_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sided(log_rows(spark, sf_dir))


def _walked(rows: DataFrame) -> DataFrame:
    """The rows of the four kinds with delta (stale strings confirmed by the next readable row), side, whether a rally is open, and the opening row's fields."""
    readable = F.col("start_string").rlike(r"^[0-9]+(-[0-9]+)+$")
    told = F.when(readable, F.when(F.col("log_type") == SIDEOUT, _part("start_string", 2)).otherwise(_part("start_string", 1)))
    rows = rows.withColumn("next_told", F.last(told, ignorenulls=True).over(_later("match_id"))).withColumn("raw", point_delta())
    stale = (F.col("raw") == 0) & F.col("point_end").isNotNull() & (F.col("next_told") == _part("start_string", 1) + 1)
    rows = rows.withColumn("delta", F.when(F.col("log_type") == POINT, F.when(stale, 1).otherwise(F.col("raw"))))
    kept = rows.where(F.col("log_type").isin(RALLY, POINT, SIDEOUT, SECOND)).withColumn("before", F.lag(F.struct("log_type", "server_uuid", "receiver_uuid", "server_side", "game_number", "start_string")).over(Window.partitionBy("match_id").orderBy("log_index")))
    is_open = F.coalesce(F.col("before.log_type") == RALLY, F.lit(False))
    own = lambda c: F.when(is_open, F.col(f"before.{c}")).otherwise(F.col(c))
    kept = kept.select(
        "match_id", "log_index", "log_type", "delta", is_open.alias("is_open"), F.lower("team_uuid").alias("team"), F.lower(own("server_uuid")).alias("server"), F.lower(own("receiver_uuid")).alias("receiver"), own("server_side").alias("by_server"),
        F.when(F.col("log_type") == POINT, F.col("game_number")).otherwise(F.col("before.game_number")).alias("game"), F.when(is_open, F.try_element_at(F.split("before.start_string", "-"), F.lit(3)).try_cast("int")).alias("server_number"),
        F.when((F.col("delta") > 0) & F.col("point_start").isNotNull(), F.col("point_start") - _part("start_string", 1)).alias("gap"))
    kept = kept.join(_sided(rows), ["match_id", "team"], "left").withColumn("side", F.when(F.col("log_type") == POINT, F.coalesce("team_side", "by_server")).otherwise(F.col("by_server")))
    gap = F.when((F.col("gap") > 0) & (F.col("gap") < 15), F.col("gap")).otherwise(0)
    return kept.where(F.col("log_type") != RALLY).withColumn("points", F.when(F.col("log_type") == POINT, F.col("delta") + gap).otherwise(0))


_WALK = f"""{_DELTA}, {_SIDES},
told as (select *, last_value(case when readable then cast(split_part(start_string, '-', case when log_type = 16 then 2 else 1 end) as int) end ignore nulls) over (partition by match_id order by log_index desc rows between unbounded preceding and 1 preceding) next_told from pt),
dl as (select *, case when log_type = 14 then case when raw = 0 and point_end is not null and next_told = a0 + 1 then 1 else raw end end delta from told),
kp as (select *, coalesce(lag(log_type) over w = 12, false) is_open, lag(server_uuid) over w bs, lag(receiver_uuid) over w br, lag(server_side) over w bd, lag(game_number) over w bg, lag(start_string) over w bt from dl where log_type in (12, 14, 16, 23) window w as (partition by match_id order by log_index)),
wk as (select kp.match_id, log_index, log_type, delta, is_open, lower(case when is_open then bs else server_uuid end) server, lower(case when is_open then br else receiver_uuid end) receiver, case when log_type = 14 then game_number else bg end game,
    case when is_open then try_cast(nullif(split_part(bt, '-', 3), '') as int) end server_number, case when log_type = 14 then coalesce(team_side, case when is_open then bd else server_side end) when is_open then bd else server_side end side,
    case when log_type = 14 then delta + case when delta > 0 and point_start - a0 > 0 and point_start - a0 < 15 then point_start - a0 else 0 end else 0 end points
    from kp left join sides on kp.match_id = sides.match_id and lower(team_uuid) = team where log_type <> 12)"""


def _events(walked: DataFrame) -> DataFrame:
    """A row for each rally: the score when it began, its outcome, and whether its point still counts after corrections.

    A correction takes back the latest points of its side that still count. The height of the stack of a side is its running sum less the lowest
    that this has been below zero; a point is taken back if the stack is lower than right after it at any later row.
    """
    game = Window.partitionBy("match_id", "game").orderBy("log_index").rowsBetween(Window.unboundedPreceding, -1)
    score = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("points")).otherwise(0)).over(game), F.lit(0)).cast("int")
    rows = walked.withColumn("p0", score(0)).withColumn("p1", score(1))
    by_side = Window.partitionBy("match_id", "side").orderBy("log_index")
    push = (F.col("log_type") == POINT) & (F.col("delta") > 0) & F.col("is_open")
    step = F.when(push, 1).when((F.col("log_type") == POINT) & (F.col("delta") < 0), F.col("delta")).otherwise(0)
    rows = rows.withColumn("total", F.sum(step).over(by_side))
    rows = rows.withColumn("height", F.col("total") - F.least(F.lit(0), F.min("total").over(by_side)))
    rows = rows.withColumn("lowest", F.min("height").over(_later("match_id", "side")))
    events = rows.where(push | F.col("log_type").isin(SIDEOUT, SECOND) & F.col("is_open"))
    won = (F.col("log_type") == POINT) & ~F.coalesce(F.col("lowest") < F.col("height"), F.lit(False))
    mine, other = F.when(F.col("side") == 0, F.col("p0")).otherwise(F.col("p1")), F.when(F.col("side") == 0, F.col("p1")).otherwise(F.col("p0"))
    return events.select(
        "match_id", "game", F.row_number().over(Window.partitionBy("match_id", "game").orderBy("log_index")).alias("rally_number"), "server", "receiver", "side",
        F.when(F.col("log_type") == POINT, "point").when(F.col("log_type") == SIDEOUT, "sideout").otherwise("second").alias("outcome"), won.cast("int").alias("won"), mine.alias("server_score"), other.alias("receiver_score"), "server_number")


_EVENTS = f"""{_WALK},
sc as (select *, cast(coalesce(sum(case when side = 0 then points else 0 end) over g, 0) as int) p0, cast(coalesce(sum(case when side = 1 then points else 0 end) over g, 0) as int) p1,
    sum(case when log_type = 14 and delta > 0 and is_open then 1 when log_type = 14 and delta < 0 then delta else 0 end) over s total from wk
    window g as (partition by match_id, game order by log_index rows between unbounded preceding and 1 preceding), s as (partition by match_id, side order by log_index)),
ht as (select *, total - least(0, min(total) over (partition by match_id, side order by log_index)) height from sc),
lw as (select *, min(height) over (partition by match_id, side order by log_index desc rows between unbounded preceding and 1 preceding) lowest from ht),
rally as (select match_id, game, row_number() over (partition by match_id, game order by log_index) rally_number, server, receiver, side, case log_type when 14 then 'point' when 16 then 'sideout' else 'second' end outcome,
    cast(log_type = 14 and not coalesce(lowest < height, false) as int) won, case when side = 0 then p0 else p1 end server_score, case when side = 0 then p1 else p0 end receiver_score, server_number
    from lw where is_open and (log_type in (16, 23) or log_type = 14 and delta > 0))"""


@query(f"with {LOGS}, {_EVENTS} select * from rally")
def log_rally_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(_walked(log_rows(spark, sf_dir)))


def _serves(events: DataFrame) -> DataFrame:
    return events.groupBy("match_id", "server", "side").agg(F.count("*").alias("rallies"), F.sum("won").alias("wins"))


@query(f"with {LOGS}, {_EVENTS} select match_id, server, count(*) rallies, sum(won) wins from rally group by all", wins="bigint")
def log_serve_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_rally_events(spark, sf_dir).groupBy("match_id", "server").agg(F.count("*").alias("rallies"), F.sum("won").alias("wins"))


_ARCHIVE = """
exp as (select match_id, game_number game, count_if(log_type = 14 and server_side = 0) s0, count_if(log_type = 14 and server_side = 1) s1 from logs group by all),
mt as (select distinct match_id, cast(null as varchar) log_status from logs union all select -1 - r_regionkey, case when r_regionkey % 2 = 0 then 'empty' else '404' end from region)"""


@query(f"""with {LOGS}, {_EVENTS}, {_ARCHIVE}, n as (select match_id, count(*) n_logs, count_if(log_type = 12) n_rallies, count_if(log_type = 14) n_points, count_if(log_type = 16) n_sideouts, count_if(log_type = 23) n_second from logs group by all),
k as (select match_id, round(sum(won) / count(*), 3) k_match from rally group by all),
got as (select match_id, game, sum(case when side = 0 then points else 0 end) g0, sum(case when side = 1 then points else 0 end) g1 from wk where log_type = 14 group by all),
chk as (select exp.match_id, bool_and(coalesce(g0, 0) = s0 and coalesce(g1, 0) = s1) good from exp left join got using (match_id, game) where match_id % 23 <> 0 group by all)
select mt.match_id, case when mt.match_id % 3 = 0 then 'singles' else 'doubles' end discipline, case when mt.match_id % 2 = 0 then 'MLP' else 'PPA' end tour, coalesce(n_logs, 0) n_logs, coalesce(n_rallies, 0) n_rallies, coalesce(n_points, 0) n_points, coalesce(n_sideouts, 0) n_sideouts,
    coalesce(n_second, 0) n_second, k_match, case when n_logs is null then log_status when good is null then 'no-games' when good then 'ok' else 'mismatch' end score_check from mt left join n using (match_id) left join k using (match_id) left join chk using (match_id)""", match_id="bigint")
def log_match_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each match of the archive: its log's counts, the servers' share, and whether the log's points are the archived ones."""
    rows = log_rows(spark, sf_dir)
    kinds = {"n_rallies": RALLY, "n_points": POINT, "n_sideouts": SIDEOUT, "n_second": SECOND}
    counts = rows.groupBy("match_id").agg(F.count("*").alias("n_logs"), *(F.count_if(F.col("log_type") == t).alias(c) for c, t in kinds.items()))
    walked = _walked(rows)
    share = _events(walked).groupBy("match_id").agg(F.round(F.sum("won") / F.count("*"), 3).alias("k_match"))
    got = walked.where(F.col("log_type") == POINT).groupBy("match_id", "game").agg(*(F.sum(F.when(F.col("side") == s, F.col("points")).otherwise(0)).alias(f"g{s}") for s in (0, 1)))
    matches = archive(spark, sf_dir)
    expected = matches.select("match_id", F.explode("games").alias("game", "score"))
    good = F.bool_and((F.coalesce("g0", F.lit(0)) == F.col("score.s0")) & (F.coalesce("g1", F.lit(0)) == F.col("score.s1")))
    checked = expected.join(got, ["match_id", "game"], "left").groupBy("match_id").agg(good.alias("good"))
    out = matches.join(counts, "match_id", "left").join(share, "match_id", "left").join(checked, "match_id", "left")
    status = F.when(F.col("n_logs").isNull(), F.col("log_status")).when(F.col("good").isNull(), "no-games").when(F.col("good"), "ok").otherwise("mismatch")
    return out.select("match_id", "discipline", "tour", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_logs", *kinds)), "k_match", status.alias("score_check"))


@query(f"""with {LOGS}, {_EVENTS} select case when match_id % 3 = 0 then 'singles' else 'doubles' end discipline, case when match_id % 2 = 0 then 'MLP' else 'PPA' end tour, sum(won) wins, count(*) rallies, round(sum(won) / count(*), 3) k from rally group by all""", wins="bigint")
def log_league_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the server wins the rally, for each discipline and tour."""
    matches = archive(spark, sf_dir).select("match_id", "discipline", "tour")
    e = log_rally_events(spark, sf_dir).join(matches, "match_id").groupBy("discipline", "tour").agg(F.sum("won").alias("wins"), F.count("*").alias("rallies"))
    return e.withColumn("k", F.round(F.col("wins") / F.col("rallies"), 3))


_STATES = f"""
op as (select *, lag(log_type) over w bt, lag(server_uuid) over w bs, lag(server_side) over w bd from logs where log_type in (12, 14, 16, 23) window w as (partition by match_id, game_number order by log_index)),
o as (select match_id, game_number, log_index, log_type, lower(bs) server, bd side from op where bt = 12 and log_type <> 12),
ch as (select *, lag(log_type) over w before, lag(side) over w last_side from o window w as (partition by match_id, game_number order by log_index)),
rs as (select *, case when before is null then 2 when before = 16 then case when side <> last_side then 1 else 2 end when side <> last_side then 2 end fresh from ch),
run as (select *, sum(cast(fresh is not null as int)) over (partition by match_id, game_number order by log_index) stretch from rs),
num as (select *, first_value(fresh) over (partition by match_id, game_number, stretch order by log_index) + coalesce(sum(cast(log_type = 23 as int)) over (partition by match_id, game_number, stretch order by log_index rows between unbounded preceding and 1 preceding), 0) number,
    coalesce(sum(cast(log_type = 14 and side = 0 as int)) over g, 0) a, coalesce(sum(cast(log_type = 14 and side = 1 as int)) over g, 0) b from run window g as (partition by match_id, game_number order by log_index rows between unbounded preceding and 1 preceding)),
fin as (select match_id, game_number, bool_or(log_type = 23 and number >= 2) bad, count_if(log_type = 14 and side = 0) fa, count_if(log_type = 14 and side = 1) fb from num group by all)"""


def _states(rows: DataFrame) -> DataFrame:
    """Each rally of a game with the score and serving state (0 to 3: first and second server of either side) it began in.

    A game opens on the second server. After a side-out the other side's first server is next; whoever the log names counts where it says otherwise, as a second server.
    A second server can't be followed by another of the same side: such a game is bad as a whole.
    """
    game = Window.partitionBy("match_id", "game_number").orderBy("log_index")
    kept = rows.where(F.col("log_type").isin(RALLY, POINT, SIDEOUT, SECOND)).withColumn("before", F.lag(F.struct("log_type", "server_uuid", "server_side")).over(game))
    done = kept.where((F.col("before.log_type") == RALLY) & (F.col("log_type") != RALLY)).select("match_id", "game_number", "log_index", "log_type", F.lower("before.server_uuid").alias("server"), F.col("before.server_side").alias("side"))
    done = done.withColumn("last", F.lag(F.struct("log_type", "side")).over(game))
    other = F.col("side") != F.col("last.side")
    fresh = F.when(F.col("last").isNull(), 2).when(F.col("last.log_type") == SIDEOUT, F.when(other, 1).otherwise(2)).when(other, 2)
    done = done.withColumn("fresh", fresh).withColumn("stretch", F.sum(F.col("fresh").isNotNull().cast("int")).over(game))
    within = Window.partitionBy("match_id", "game_number", "stretch").orderBy("log_index")
    seconds = F.coalesce(F.sum((F.col("log_type") == SECOND).cast("int")).over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = game.rowsBetween(Window.unboundedPreceding, -1)
    points = lambda s, w: F.coalesce(F.sum(((F.col("log_type") == POINT) & (F.col("side") == s)).cast("int")).over(w), F.lit(0)).cast("int")
    done = done.withColumn("number", F.first("fresh").over(within) + seconds).withColumn("a", points(0, before)).withColumn("b", points(1, before))
    whole = Window.partitionBy("match_id", "game_number")
    return done.select(
        "match_id", "game_number", "log_index", "a", "b", (2 * F.col("side") + F.col("number") - 1).cast("int").alias("state"), "server", "side", (F.col("log_type") == POINT).cast("int").alias("won"),
        F.max(((F.col("log_type") == SECOND) & (F.col("number") >= 2)).cast("int")).over(whole).alias("bad"), points(0, whole).alias("final_a"), points(1, whole).alias("final_b"))


@query(f"""with {LOGS}, {_STATES}, ar as (select match_id, game_number, count_if(log_type = 14 and server_side = 0) s0, count_if(log_type = 14 and server_side = 1) s1 from logs group by all)
select num.match_id, num.game_number, log_index, cast(a as int) a, cast(b as int) b, cast(2 * side + number - 1 as int) state, server, side, cast(log_type = 14 as int) won from num join fin using (match_id, game_number) join ar using (match_id, game_number)
where not bad and fa = s0 - match_id % 2 * (s0 - fa) and fb = s1 - match_id % 2 * (s1 - fb)""")
def log_serve_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serving states of the games whose walk ends at the archived score; of odd matches the archive is taken to say what the walk says."""
    rows = log_rows(spark, sf_dir)
    said = rows.groupBy("match_id", "game_number").agg(*(F.count_if((F.col("log_type") == POINT) & (F.col("server_side") == s)).cast("int").alias(f"s{s}") for s in (0, 1)))
    odd = F.col("match_id") % 2 == 1
    good = _states(rows).join(said, ["match_id", "game_number"]).where("bad = 0").where(odd | ((F.col("final_a") == F.col("s0")) & (F.col("final_b") == F.col("s1"))))
    return good.select("match_id", "game_number", "log_index", "a", "b", "state", "server", "side", "won")
