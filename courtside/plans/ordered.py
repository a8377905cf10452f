"""Windows and other things that depend on order. Every order ends in a unique key."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.registry import query
from courtside.operators.ranks import ranked_within
from courtside.operators.rally import elo_by_pool, retracted
from courtside.plans.lookups import _MONTHS, _months
from courtside.sources.tables import GAMES, RALLIES, SLOTS, games, rallies, slots, table


def _ahead(w, a=None, b=None):
    return w.rowsBetween(Window.unboundedPreceding if a is None else a, -1 if b is None else b)


@query("select c_custkey, c_mktsegment, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as rank from customer")
def gender_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", (-F.col("c_acctbal")).alias("down"))
    return ranked_within(rows, ["c_mktsegment"], ["down", "c_custkey"], "rank").select("c_custkey", "c_mktsegment", "rank")


@query(f"""with {GAMES} select gid, cast(count(*) over (partition by a1, a2 order by "date", gid) <= 6 and count(*) over (partition by a1, a2) >= 15 as int) fresh from games""")
def newness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six games of a pair that goes on to play fifteen."""
    pair = Window.partitionBy("a1", "a2")
    return games(spark, sf_dir).select("gid", ((F.row_number().over(pair.orderBy("date", "gid")) <= 6) & (F.count("*").over(pair) >= 15)).cast("int").alias("fresh"))


_STREAKS = """w as (select player, won, "date", gid, slot, row_number() over (partition by player order by "date", gid, slot) r, row_number() over (partition by player, won order by "date", gid, slot) k from slots),
i as (select player, won, r - k isle, count(*) n, max(r) til from w group by all)"""


@query(f"""with {GAMES}, {SLOTS}, {_STREAKS} select player, arg_max(case when won = 1 then n else -n end, til) as current, coalesce(max(case when won = 1 then n end), 0) best from i group by player""")
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed current streak and best winning streak: islands between changes."""
    order = ["date", "gid", "slot"]
    w = slots(games(spark, sf_dir)).select(
        "player", "won", F.row_number().over(Window.partitionBy("player").orderBy(*order)).alias("r"), F.row_number().over(Window.partitionBy("player", "won").orderBy(*order)).alias("k"))
    isles = w.groupBy("player", "won", (F.col("r") - F.col("k")).alias("isle")).agg(F.count("*").alias("n"), F.max("r").alias("til"))
    return isles.groupBy("player").agg(F.max_by(F.when(F.col("won") == 1, F.col("n")).otherwise(-F.col("n")), "til").alias("current"), F.coalesce(F.max(F.when(F.col("won") == 1, F.col("n"))), F.lit(0)).alias("best"))


@query(f"""with {_MONTHS}, l as (select k, "month", v, lag(v, 6) over (partition by k order by "month") old, row_number() over (partition by k order by "month" desc) r from m)
select k, round(v - old, 2) form from l where r = 1 and old is not null""")
def form_lag6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last month's value less that of six entries before."""
    w = Window.partitionBy("k").orderBy("month")
    lagged = _months(spark, sf_dir).withColumn("old", F.lag("v", 6).over(w)).groupBy("k").agg(F.max_by(F.struct("v", "old"), "month").alias("last"))
    return lagged.where("last.old is not null").select("k", F.round(F.col("last.v") - F.col("last.old"), 2).alias("form"))


@query("select s_suppkey, s_nationkey, round(percent_rank() over (partition by s_nationkey order by s_acctbal) * 100, 6) pct from supplier")
def chem_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal values have the place of the first of them."""
    placed = ranked_within(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"), ["s_nationkey"], ["s_acctbal", "s_suppkey"], "place", "n")
    first = placed.groupBy("s_nationkey", "s_acctbal").agg(F.min("place").alias("first"))
    share = F.when(F.col("n") > 1, (F.col("first") - 1) / (F.col("n") - 1)).otherwise(0.0)
    return placed.join(first, ["s_nationkey", "s_acctbal"]).select("s_suppkey", "s_nationkey", F.round(share * 100, 6).alias("pct"))


@query(f"""with {RALLIES}, l as (select *, first_value(case when log_type in (14, 16, 23) then k end ignore nulls) over (partition by match_id order by log_index rows between 1 following and unbounded following) nxt from rallies)
select log_index, cast(coalesce(nxt > k, false) as int) confirmed from l where log_type = 14""")
def lookahead_confirm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Is a point confirmed by the first later row that can be read?"""
    w = Window.partitionBy("match_id").orderBy("log_index").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("log_type").isin(14, 16, 23), F.col("k")), ignorenulls=True).over(w)
    return rallies(spark, sf_dir).withColumn("nxt", nxt).where("log_type = 14").select("log_index", F.coalesce(F.col("nxt") > F.col("k"), F.lit(False)).cast("int").alias("confirmed"))


@query(f"""with {RALLIES}, l as (select *, lag(log_type) over w prev, lag(side) over w server from rallies where log_type in (12, 14, 16, 23) window w as (partition by match_id order by log_index))
select match_id, server, count(*) rallies, sum(cast(log_type = 14 and k >= 5 as int)) wins from l where log_type <> 12 and prev = 12 group by all""", wins="bigint")
def rally_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An outcome belongs to the rally that the row before it opened."""
    w = Window.partitionBy("match_id").orderBy("log_index")
    kept = rallies(spark, sf_dir).where(F.col("log_type").isin(12, 14, 16, 23))
    tied = kept.select("match_id", "log_type", "k", F.lag("log_type").over(w).alias("prev"), F.lag("side").over(w).alias("server")).where("log_type <> 12 and prev = 12")
    return tied.groupBy("match_id", "server").agg(F.count("*").alias("rallies"), F.sum(F.expr("cast(log_type = 14 and k >= 5 as int)")).alias("wins"))


@query(f"""with {RALLIES}, z as (select log_index, match_id, "value", avg("value") over (partition by match_id, side) m, stddev_pop("value") over (partition by match_id, side) s from rallies)
select log_index, round(("value" - m) / s, 4) z from z where s >= 1e-9""")
def leverage_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("match_id", "side")
    return rallies(spark, sf_dir).select("log_index", "value", F.avg("value").over(w).alias("m"), F.stddev_pop("value").over(w).alias("s")).where("s >= 1e-9").select("log_index", F.round((F.col("value") - F.col("m")) / F.col("s"), 4).alias("z"))


_DAY = "(year(\"date\") * 12 + month(\"date\")) * 31 + day(\"date\")"


@query(f"""with {GAMES}, {SLOTS}, d as (select player, {_DAY} dd, sum((pf - pa) / (pf + pa)) r from slots group by all),
x as (select player, dd, sum(r * pow(2.0, (dd - 742500) / 45.0)) over (partition by player order by dd rows between unbounded preceding and 1 preceding) acc from d)
select player, dd as day, round(coalesce(acc, 0) * pow(2.0, -(dd - 742500) / 45.0), 5) + 0.0 momentum from x""")
def momentum_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals of strictly earlier days, each halved every 45 of the (uneven) days that are counted; one row a player and day."""
    day = (F.year("date") * 12 + F.month("date")) * 31 + F.dayofmonth("date")
    d = slots(games(spark, sf_dir)).groupBy("player", day.alias("day")).agg(F.sum((F.col("pf") - F.col("pa")) / (F.col("pf") + F.col("pa"))).alias("r"))
    grown = F.pow(F.lit(2.0), (F.col("day") - 742500) / F.lit(45.0))
    acc = F.sum(F.col("r") * grown).over(_ahead(Window.partitionBy("player").orderBy("day")))
    return d.select("player", "day", (F.round(F.coalesce(acc, F.lit(0.0)) / grown, 5) + 0.0).alias("momentum"))


@query("select o_custkey, min(o_orderkey) first_order from (select o_custkey, o_orderkey, o_orderdate, min(o_orderdate) over (partition by o_custkey) f from orders) where o_orderdate = f group by o_custkey")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first-seen row of each key."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).getField("o_orderkey").alias("first_order"))


@query("select event_id, user_id, event_type from (select *, lag(event_type) over (partition by user_id order by event_id) prev from events) where prev is null or prev <> event_type")
def change_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that differ from the one before of their key."""
    prev = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id"))
    return table(spark, sf_dir, "events").withColumn("prev", prev).where("prev is null or prev <> event_type").select("event_id", "user_id", "event_type")


@query("select o_orderpriority, o_orderkey, r from (select *, row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) r from orders) where r <= 15")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: Spark limits each group before the shuffle."""
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderkey", F.row_number().over(w).alias("r")).where("r <= 15")


@query(f"""with {GAMES} select match_id, gid, coalesce(sum(cast(margin > 0 as int)) over w, 0) w1, coalesce(sum(cast(margin < 0 as int)) over w, 0) w2, coalesce(sum(s1 + s2) over w, 0) x_offset from games
window w as (partition by match_id order by game_no, gid rows between unbounded preceding and 1 preceding)""", w1="bigint", w2="bigint", x_offset="bigint")
def running_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _ahead(Window.partitionBy("match_id").orderBy("game_no", "gid"))
    run = lambda x: F.coalesce(F.sum(x).over(w), F.lit(0))
    return games(spark, sf_dir).select("match_id", "gid", run((F.col("margin") > 0).cast("int")).alias("w1"), run((F.col("margin") < 0).cast("int")).alias("w2"), run(F.col("s1") + F.col("s2")).alias("x_offset"))


@query(f"""with {GAMES}, {SLOTS} select player, gid, slot, case when r * 2 <= n - n % 2 then 1 else 2 end half from (
select player, gid, slot, row_number() over (partition by player order by "date", gid, slot) r, count(*) over (partition by player) n from slots)""")
def date_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("player")
    ranked = slots(games(spark, sf_dir)).select("player", "gid", "slot", F.row_number().over(own.orderBy("date", "gid", "slot")).alias("r"), F.count("*").over(own).alias("n"))
    return ranked.select("player", "gid", "slot", F.when(F.expr("r * 2 <= n - n % 2"), 1).otherwise(2).alias("half"))


@query(f"with {GAMES}, {SLOTS} select player, gid, slot from (select player, gid, slot, row_number() over (partition by player order by \"date\" desc, gid, slot) r from slots) where r <= 12")
def last_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("player").orderBy(F.desc("date"), "gid", "slot")
    return slots(games(spark, sf_dir)).select("player", "gid", "slot", F.row_number().over(w).alias("r")).where("r <= 12").drop("r")


@query(None)
def elo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential ratings of each context's players after all its games."""
    return elo_by_pool(games(spark, sf_dir).where(~F.col("is_forfeit")), "context")


@query(None)
def retractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points after corrections: a negative one takes back the latest that still counts."""
    return retracted(rallies(spark, sf_dir))
