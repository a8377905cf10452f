"""Big rallies and strong opponents, odds split by serve, scores of deciders, and draws that are no knockout."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.functions.probability import SIGMOID, serve_chances, sigmoid
from courtside.operators.clutch import SUMS, clutch_scores, leveraged, month_halves, slopes, standard_halves, summed, trait_summary
from courtside.operators.ranks import ranked_within
from courtside.operators.serve import decider_scores, serve_table
from courtside.plans.pricing import log_states, match_gap
from courtside.registry import query
from courtside.sources.logs import LOGS, POINT, log_rows
from courtside.sources.storage import written
from courtside.sources.tables import GAMES, RATING, games, rating, table


def _scores(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    after = log_rows(spark, sf_dir).select("match_id", "log_index", F.col("server_uuid").alias("server"), (F.lead("log_type").over(Window.partitionBy("match_id").orderBy("log_index")) == POINT).cast("int").alias("won"))
    rallies = log_states(spark, sf_dir).join(after.where("won is not null"), ["match_id", "log_index"])
    return clutch_scores(leveraged(rallies, serve_table(rallies.select("eta").distinct(), 11), ["match_id"]), least)


@query(None)
def clutch(spark: SparkSession, sf_dir: str, least: int = 10) -> DataFrame:
    """Servers' results in rallies of more leverage within the match, with the exact spread of the score under new deals; least is low as logs are short here."""
    return _scores(spark, sf_dir, least)


@query(None)
def clutch_spread(spark: SparkSession, sf_dir: str, least: int = 10) -> DataFrame:
    """Whether the scores of `clutch` say anything: their variance, halves against each other, and what their servers' values leave of it."""
    return trait_summary(_scores(spark, sf_dir, least).withColumn("value", rating(F.substring("server", 2, 20).cast("long"))), "clutch")


_GAP = "(" + " + ".join(f"{s} * {RATING.format(p=f'(match_id * 4 + {i})')}" for i, s in enumerate((1, 1, -1, -1))) + ")"


@query(f"""with {LOGS}, t as (select match_id, server_side, count(*) n, count(*) filter (where log_type = 14) w from logs where log_type in (14, 16, 23) group by all having count(*) >= 15),
k as (select *, 0.443 / 0.557 * sqrt(exp(case server_side when 0 then {_GAP} else -{_GAP} end)) r from t),
x as (select ln(r) x, ln((w + 0.5) / (n - w + 0.5)) y, n from k), m as (select sum(n * x) / sum(n) mx, sum(n * y) / sum(n) my from x)
select round(sum(n * (x - mx) * (y - my)) / sum(n * (x - mx) * (x - mx)), 5) slope, round(any_value(my) - sum(n * (x - mx) * (y - my)) / sum(n * (x - mx) * (x - mx)) * any_value(mx), 5) intercept, count(*) sides from x, m""")
def serve_split(spark: SparkSession, sf_dir: str, least: int = 15) -> DataFrame:
    """Each match's and side's won serves against the chance its difference gives, in logits, by a line weighted by rallies: slope 1 and intercept 0 would bear the split out."""
    t = log_rows(spark, sf_dir).where(F.col("log_type").isin(14, 16, 23)).groupBy("match_id", "server_side").agg(F.count("*").alias("n"), F.count_if(F.col("log_type") == POINT).alias("w")).where(F.col("n") >= least)
    eta = match_gap(F.col("match_id"))
    k, _ = serve_chances(F.when(F.col("server_side") == 0, eta).otherwise(-eta), 0.443)
    x = t.select("n", F.ln(k / (1 - k)).alias("x"), F.ln((F.col("w") + 0.5) / (F.col("n") - F.col("w") + 0.5)).alias("y"))
    s = x.agg(*(F.sum(F.expr(e)).alias(a) for a, e in {"n": "n", "nx": "n * x", "ny": "n * y", "nxx": "n * x * x", "nxy": "n * x * y"}.items()), F.count("*").alias("sides"))
    slope = (F.col("nxy") - F.col("nx") * F.col("ny") / F.col("n")) / (F.col("nxx") - F.col("nx") * F.col("nx") / F.col("n"))
    return s.select(F.round(slope, 5).alias("slope"), F.round(F.col("ny") / F.col("n") - slope * F.col("nx") / F.col("n"), 5).alias("intercept"), "sides")


@query(None)
def decider_score_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chance of each last score of a decider with freeze, for the distinct sets of four rally chances in use."""
    x = F.col("o_orderkey")
    ps = F.array(*((0.3 + 0.05 * (x % m)).cast("double") for m in (7, 5, 3, 8)))
    return decider_scores(table(spark, sf_dir, "orders").select(F.transform(ps, lambda p: F.round(p, 6)).alias("ps")))


#: Rounds of a knockout, by their names in the given table.
KNOCKOUT = ("1-URGENT", "3-MEDIUM")
_KNOWN = "count(*) filter (where o_orderpriority in ('1-URGENT', '3-MEDIUM'))"


@query(f"""select o_custkey draw, count(*) n, {_KNOWN} known, count(distinct o_orderkey % 16) entrants,
case when count(distinct o_orderkey % 16) < 4 then 'few' when {_KNOWN} * 2 < count(*) then 'groups' else 'knockout' end kind from orders group by o_custkey""")
def draw_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws with four entrants and more whose rounds are known for at least half of their matches are knockouts; others have groups, or too few entrants."""
    known = F.coalesce(F.col("o_orderpriority").isin(*KNOCKOUT), F.lit(False))
    d = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("draw")).agg(F.count("*").alias("n"), F.count_if(known).alias("known"), F.count_distinct(F.col("o_orderkey") % 16).alias("entrants"))
    return d.withColumn("kind", F.when(F.col("entrants") < 4, "few").when(F.col("known") * 2 < F.col("n"), "groups").otherwise("knockout"))


#: What a pair's difference adds to its sum, and a stand-in for what a pair has beyond that.
GAMMA = -0.2


def bond(x, y):
    return (F.least(x, y) * 7 + F.greatest(x, y) * 3) % 11 / F.lit(100.0) - F.lit(0.05)


_BOND = "((least({x}, {y}) * 7 + greatest({x}, {y}) * 3) % 11 / 100.0 - 0.05)"


def _team(x, y):
    return rating(x) + rating(y) + GAMMA * F.abs(rating(x) - rating(y))


_TEAM = f"({RATING.format(p='{x}')} + {RATING.format(p='{y}')} - 0.2 * abs({RATING.format(p='{x}')} - {RATING.format(p='{y}')}))"
_SIDES = ({"x": "a1", "y": "a2"}, {"x": "b1", "y": "b2"})
_GAP_SQL = "round(t1 - t2 + " + _BOND.format(**_SIDES[0]) + " - " + _BOND.format(**_SIDES[1]) + ", 9)"
_MOMENTS = "count(*) n, covar_pop(x, y) / nullif(var_pop(x), 0) slope, var_pop(x) vx, var_pop(y) vy, regr_slope(y, x) filter (where half = 1) half1, regr_slope(y, x) filter (where half = 2) half2"
_DURABILITY = f"""{GAMES}, tv as (select *, {_TEAM.format(**_SIDES[0])} t1, {_TEAM.format(**_SIDES[1])} t2 from games where not is_forfeit), rs as (select *, s1 / (s1 + s2) - {SIGMOID.format(x=_GAP_SQL)} r from tv),
st as (select avg(t) mu, stddev_pop(t) sd from (select t1 t from tv union all select t2 from tv)),
pr as (select a1 player, 1 slot, t2 opp, r y, "date", gid, s1, s2 from rs union all select a2, 2, t2, r, "date", gid, s1, s2 from rs union all select b1, 3, t1, -r, "date", gid, s1, s2 from rs union all select b2, 4, t1, -r, "date", gid, s1, s2 from rs),
hv as (select player, (opp - mu) / sd x, y, case when row_number() over (partition by player order by "date", gid, slot, s1, s2) <= count(*) over (partition by player) // 2 then 1 else 2 end half from pr, st),
du as (select *, sqrt(vy / vx / (n - 1)) null_sd from (select player, {_MOMENTS} from hv group by player) where n >= 60 and vx >= 1e-12)"""


def _seen(g: DataFrame) -> DataFrame:
    """Four rows a game: player, slot, the opponents' strength and the result beyond expectation, and by what a player's games are ordered."""
    g = g.withColumns({"t1": _team(F.col("a1"), F.col("a2")), "t2": _team(F.col("b1"), F.col("b2"))})
    gap = F.round(F.col("t1") - F.col("t2") + bond(F.col("a1"), F.col("a2")) - bond(F.col("b1"), F.col("b2")), 9)
    g = g.withColumn("r", F.col("s1") / (F.col("s1") + F.col("s2")) - sigmoid(gap))  # once a game, not once a player
    seen = F.array(*(F.struct(F.col(p).alias("player"), F.lit(k).alias("slot"), F.col(opp).alias("opp"), (F.col("r") * sign).alias("y")) for k, (p, opp, sign) in enumerate((("a1", "t2", 1), ("a2", "t2", 1), ("b1", "t1", -1), ("b2", "t1", -1)), 1)))
    return g.select("month", "date", "gid", "s1", "s2", F.inline(seen))


def _durability(spark: SparkSession, sf_dir: str, least: int) -> DataFrame:
    """Games are written once and summed by player and month; only those of a month in which a player's halves meet are ranked one by one."""
    month = F.year("date") * 12 + F.month("date")
    g = written(games(spark, sf_dir).where(~F.col("is_forfeit")).select(month.alias("month"), "date", "gid", "a1", "a2", "b1", "b2", "s1", "s2"), "games")
    months = written(month_halves(summed(_seen(g), "player", "month")), "months")
    meet = months.where("half is null").select(F.col("player").alias("p"), F.col("month").alias("m"), "take")  # a row a player
    few = g.join(F.broadcast(meet.select("m").distinct()), F.col("month").eqNullSafe(F.col("m")), "left_semi")
    rows = _seen(few).join(F.broadcast(meet), F.col("player").eqNullSafe(F.col("p")) & F.col("month").eqNullSafe(F.col("m")))
    rows = ranked_within(rows.select("player", "date", "gid", "slot", "s1", "s2", "opp", "y", "take"), ["player"], ["date", "gid", "slot", "s1", "s2"], "_i").withColumn("half", F.when(F.col("_i") <= F.col("take"), 1).otherwise(2))
    parts = months.where("half is not null").select("player", "half", *SUMS).unionByName(summed(rows, "player", "half"))
    return slopes(standard_halves(parts), least)


@query(f"with {_DURABILITY} select player, n, round(slope, 6) slope, round(null_sd, 6) null_sd, round(slope / null_sd, 4) z, round(half1, 6) half1, round(half2, 6) half2 from du")
def durability(spark: SparkSession, sf_dir: str, least: int = 60) -> DataFrame:
    """How players' results beyond expectation go with the opponents' strength, against the exact spread under new deals, and in the earlier and the later half of their games."""
    s = _durability(spark, sf_dir, least)
    return s.select("player", "n", *(F.round(c, d).alias(c) for c, d in (("slope", 6), ("null_sd", 6), ("z", 4), ("half1", 6), ("half2", 6))))


@query(f"""with {_DURABILITY}, v as (select *, slope / null_sd z, {RATING.format(p='player')} as val from du), l as (select regr_slope(slope, val) b, regr_intercept(slope, val) a from v)
select count(*) players, round(avg(z), 5) z_mean, round(var_pop(z), 5) z_var, round(corr(half1, half2), 5) half_r, round(corr(val, slope), 5) value_r, round(any_value(b), 5) trend,
round(var_pop((slope - a - b * val) / null_sd), 5) z_var_rest, round(corr(half1 - a - b * val, half2 - a - b * val), 5) half_r_rest from v, l""")
def durability_spread(spark: SparkSession, sf_dir: str, least: int = 60) -> DataFrame:
    """Whether the slopes of `durability` say anything: more spread than by chance, halves that agree, and what is left when players' own values are taken out."""
    s = trait_summary(_durability(spark, sf_dir, least).withColumn("value", rating(F.col("player"))), "slope")
    return s.select("players", *(F.round(c, 5).alias(c) for c in s.columns[1:]))
