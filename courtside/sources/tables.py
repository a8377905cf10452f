"""Readers. Competition records are read from the supplied star schema: an order is a match, its lines are the games.

GAMES and RALLIES are the same definitions as SQL, for the oracles.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.sources.storage import folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stored bytes of games that a task joins, and then often groups by match: some 150,000 rows.
PART_BYTES = 4 << 20


def stored(spark: SparkSession, path: str) -> int:
    fs, at = folder(spark, path)
    return fs.getContentSummary(at).getLength()


def games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each game: sides a (players a1, a2) and b (b1, b2), their scores s1 and s2, and where it was played."""
    line, order = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    parts = stored(spark, f"{sf_dir}/lineitem.parquet") // PART_BYTES
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):  # what a task sorts and groups by match doesn't go with the table
        line, order = line.repartition(parts, "l_orderkey"), order.repartition(parts, "o_orderkey")
    g = line.join(order, line.l_orderkey == order.o_orderkey)
    q, target = F.col("l_quantity").cast("int"), F.when(F.col("l_linestatus") == "O", 15).otherwise(11)
    lose = F.when(q % 10 == 0, target - 1).otherwise(q % (target - 1))
    first = (F.col("l_partkey") + F.col("l_suppkey") + F.col("l_linenumber")) % 2 == 0
    g = g.select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("gid"), F.col("l_orderkey").alias("match_id"), F.col("l_linenumber").alias("game_no"),
        F.col("o_orderdate").cast("date").alias("date"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "MLP").otherwise("PPA").alias("tour"),
        F.when(F.col("l_returnflag") == "R", "mixed").when(F.col("l_returnflag") == "A", "mens").otherwise("womens").alias("context"),
        target.alias("target"), (F.when(F.col("l_linestatus") == "O", 5).otherwise(3)).alias("best_of"), (F.col("l_discount") > 0.09).alias("is_forfeit"),
        (F.col("l_suppkey") % 97).alias("a1"), (F.col("l_partkey") % 89 + 100).alias("a2"), (F.col("o_custkey") % 83 + 200).alias("b1"), ((F.col("l_partkey") + F.col("l_suppkey")) % 79 + 300).alias("b2"),
        lose.alias("lose"), F.when(lose == target - 1, target + 1).otherwise(target).alias("win"), first.alias("first_wins"))
    s1, s2 = F.when(F.col("first_wins"), F.col("win")).otherwise(F.col("lose")), F.when(F.col("first_wins"), F.col("lose")).otherwise(F.col("win"))
    return g.withColumns({"s1": s1, "s2": s2}).withColumn("margin", F.col("s1") - F.col("s2")).drop("lose", "win", "first_wins")


GAMES = """
base as (select l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey gid, l_orderkey match_id, l_linenumber game_no, cast(o_orderdate as date) "date",
    case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'MLP' else 'PPA' end tour,
    case l_returnflag when 'R' then 'mixed' when 'A' then 'mens' else 'womens' end context,
    case l_linestatus when 'O' then 15 else 11 end target, case l_linestatus when 'O' then 5 else 3 end best_of, l_discount > 0.09 is_forfeit,
    l_suppkey % 97 a1, l_partkey % 89 + 100 a2, o_custkey % 83 + 200 b1, (l_partkey + l_suppkey) % 79 + 300 b2,
    cast(l_quantity as int) q, (l_partkey + l_suppkey + l_linenumber) % 2 = 0 first_wins from lineitem join orders on l_orderkey = o_orderkey),
scored as (select *, case when q % 10 = 0 then target - 1 else q % (target - 1) end lose from base),
ended as (select *, case when lose = target - 1 then target + 1 else target end win from scored),
games as (select gid, match_id, game_no, "date", tour, context, target, best_of, is_forfeit, a1, a2, b1, b2,
    case when first_wins then win else lose end s1, case when first_wins then lose else win end s2,
    case when first_wins then win - lose else lose - win end margin from ended)
"""


def slots(g: DataFrame) -> DataFrame:
    """Four rows for each game, one for each player, seen from that player's side."""
    seen = [(1, "a1", "a2", 1), (2, "a2", "a1", 1), (3, "b1", "b2", 2), (4, "b2", "b1", 2)]
    rows = [F.struct(F.lit(n).alias("slot"), F.col(p).alias("player"), F.col(m).alias("partner"), F.lit(s).alias("side"), F.col("s1" if s == 1 else "s2").alias("pf"), F.col("s2" if s == 1 else "s1").alias("pa")) for n, p, m, s in seen]
    return g.select("*", F.inline(F.array(*rows))).withColumn("won", (F.col("pf") > F.col("pa")).cast("int"))


SLOTS = """
slots as (select *, cast(pf > pa as int) won from (
    select *, 1 slot, a1 player, a2 partner, 1 side, s1 pf, s2 pa from games union all select *, 2, a2, a1, 1, s1, s2 from games
    union all select *, 3, b1, b2, 2, s2, s1 from games union all select *, 4, b2, b1, 2, s2, s1 from games))
"""


def rallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The referees' log: events of two users are a match, each user is a side; log types by event type."""
    e = table(spark, sf_dir, "events")
    kind = F.create_map(*(F.lit(x) for pair in LOG_TYPES.items() for x in pair))
    return e.select(F.floor(F.col("user_id") / 2).alias("match_id"), (F.col("user_id") % 2).alias("side"), F.col("event_id").alias("log_index"), kind[F.col("event_type")].alias("log_type"), F.get_json_object("props", "$.k").cast("int").alias("k"), "value", "ts")


#: 12 opens a rally, 14 is a point, 16 a side-out, 23 a second server; anything else is about the match.
LOG_TYPES = {"view": 12, "click": 14, "purchase": 16, "signup": 23, "error": 22}
RALLIES = """
rallies as (select user_id // 2 match_id, user_id % 2 side, event_id log_index, case event_type when 'view' then 12 when 'click' then 14 when 'purchase' then 16 when 'signup' then 23 when 'error' then 22 end log_type,
    cast(json_extract_string(props, '$.k') as int) k, "value", ts from events)
"""


def rating(player):
    """A player's value in logits: a stand-in for a fitted one."""
    return (player * 37 % 101) / F.lit(100.0) - F.lit(0.5)


RATING = "((({p}) * 37 % 101) / 100.0 - 0.5)"
