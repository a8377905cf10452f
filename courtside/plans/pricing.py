"""Prices of games, series and deciders, and what is asked of them: margins, tails, what-ifs, win series of logs."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.registry import query
from courtside.functions.probability import GAMMA, SIGMOID, calibrated, floored, percent, race_margin, race_modal, race_pmf, race_win, sigmoid, team_eta, wins_pmf
from courtside.operators.serve import anchored, deciders, mixed_serve_table, rally_chance, serve_table
from courtside.plans.kernels import _COMB, _fixtures
from courtside.sources.logs import RALLY, log_rows
from courtside.sources.tables import GAMES, RATING, games, rating, table

_ETA = "(({0} + {1} - 0.1829 * abs({0} - {1})) - ({2} + {3} - 0.1829 * abs({2} - {3})))"
_ENDS = f"""ends as (select p, b o, '11-' || b score, 11 - b d, {_COMB.format(n='10 + b', k='b')} * pow(p, 11) * pow(1 - p, b) pr from ps, range(0, 10) t(b)
    union all select p, 10 + b, b || '-11', b - 11, {_COMB.format(n='10 + b', k='b')} * pow(1 - p, 11) * pow(p, b) from ps, range(0, 10) t(b)),
deuce as (select p, {_COMB.format(n='20', k='10')} * pow(p * (1 - p), 10) dm, p * p / (p * p + (1 - p) * (1 - p)) dw from ps),
price as (select p, sum(case when d > 0 then pr else 0 end) + any_value(dm * dw) win, sum(d * pr) + any_value(2 * dm * dw - 2 * dm * (1 - dw)) margin, arg_max(score, round(pr, 11) - o * 1e-13) modal from ends join deuce using (p) group by p)"""


@query(f"""with {GAMES}, pg as (select gid, case when a1 % 31 <> 0 and b2 % 37 <> 0 then round_even({SIGMOID.format(x=_ETA.format(*(RATING.format(p=c) for c in ('a1', 'a2', 'b1', 'b2'))))}, 4) end p from games), ps as (select distinct p from pg where p is not null), {_ENDS}
select gid, round((1 - 0.02118) * {SIGMOID.format(x='0.06 + 0.9 * ln(win / (1 - win))')} + 0.01059, 4) p, modal, round(margin, 2) + 0.0 margin from pg left join price using (p)""")
def priced_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each game's calibrated chance, likeliest score and expected margin; null where a player has no rating (here: some ids).

    The kernels run once for each chance of four digits, so at most 10,001 rows are broadcast back.
    """
    known = (F.col("a1") % 31 != 0) & (F.col("b2") % 37 != 0)
    eta = team_eta(*(rating(F.col(c)) for c in ("a1", "a2", "b1", "b2")))
    rows = games(spark, sf_dir).select("gid", F.when(known, F.bround(sigmoid(eta), 4)).alias("x"))
    memo = rows.select("x").where("x is not null").distinct()
    memo = memo.select("x", F.round(calibrated(race_win(F.col("x"), 11)), 4).alias("p"), race_modal(F.col("x"), 11).alias("modal"), (F.round(race_margin(F.col("x"), 11), 2) + 0.0).alias("margin"))
    return rows.join(F.broadcast(memo), "x", "left").drop("x")


@query(f"""with v as (select s_suppkey, s_acctbal / 10000.0 v from supplier), pv as (select s_suppkey, round_even({SIGMOID.format(x='v - 0.1829 * abs(v)')}, 4) p from v), ps as (select distinct p from pv), {_ENDS} select s_suppkey, round(margin, 6) + 0.0 points from pv join price using (p)""")
def value_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value as the expected margin of a player, with an average partner, against an average pair."""
    v = F.col("s_acctbal") / 10000.0
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", F.bround(sigmoid(v + GAMMA * F.abs(v)), 4).alias("x"))
    memo = rows.select("x").distinct().withColumn("points", F.round(race_margin(F.col("x"), 11), 6) + 0.0)
    return rows.join(F.broadcast(memo), "x").drop("x")


@query("""with f as (select o_orderkey, (o_orderkey % 7 + 1) / 8.0 a, (o_orderkey % 11 + 1) / 12.0 b, (o_orderkey % 13 + 1) / 14.0 c, (o_orderkey % 17 + 1) / 18.0 d, (o_orderkey % 5 + 1) / 6.0 e from orders),
x as (select o_orderkey, i + j + k w, (case i when 1 then a else 1 - a end) * (case j when 1 then b else 1 - b end) * (case k when 1 then c else 1 - c end) pr, d, e from f, range(2) t(i), range(2) u(j), range(2) v(k))
select o_orderkey, round(sum(case when w >= 2 then pr else 0 end), 9) of3, round(sum(case w when 3 then pr * (1 - (1 - d) * (1 - e) * 0) when 2 then pr * (1 - (1 - d) * (1 - e)) when 1 then pr * d * e else 0 end), 9) of5 from x group by o_orderkey""")
def series_by_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best of three and of five with a chance of its own for each game: whoever has won most would also have if all were played."""
    chances = [*(F.col(f"p{k}") for k in range(4)), F.col("db")]
    three, five = wins_pmf(chances[:3]), wins_pmf(chances)
    f = _fixtures(spark, sf_dir).select("o_orderkey", three.alias("w3"), five.alias("w5"))
    total = lambda c, least: F.aggregate(F.slice(c, least + 1, 9), F.lit(0.0), lambda acc, x: acc + x)
    return f.select("o_orderkey", F.round(total("w3", 2), 9).alias("of3"), F.round(total("w5", 3), 9).alias("of5"))


@query("""with f as (select o_orderkey, o_orderkey % 3 w1, (o_orderkey // 3) % 2 w2, (o_orderkey % 7 + 1) / 8.0 a, (o_orderkey % 11 + 1) / 12.0 b, (o_orderkey % 13 + 1) / 14.0 c, (o_orderkey % 17 + 1) / 18.0 d, (o_orderkey % 5 + 1) / 6.0 db from orders),
x as (select o_orderkey, db, w1 + case when w1 + w2 < 4 then l else 0 end + case when w1 + w2 < 3 then k else 0 end + case when w1 + w2 < 2 then j else 0 end + case when w1 + w2 < 1 then i else 0 end w,
    (case when w1 + w2 >= 1 then 0.5 when i = 1 then a else 1 - a end) * (case when w1 + w2 >= 2 then 0.5 when j = 1 then b else 1 - b end) * (case when w1 + w2 >= 3 then 0.5 when k = 1 then c else 1 - c end) * (case when l = 1 then d else 1 - d end) pr
    from f, range(2) t(i), range(2) u(j), range(2) v(k), range(2) y(l))
select o_orderkey, round(sum(case when w >= 3 then pr when w = 2 then pr * db else 0 end), 9) p from x group by o_orderkey""")
def matchup_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixture's chance from where it stands: games won so far, those to come, and a decider at two all."""
    w1, w2 = (F.col("o_orderkey") % 3).cast("int"), (F.floor(F.col("o_orderkey") / 3) % 2).cast("int")
    f = _fixtures(spark, sf_dir).withColumns({"w1": w1, "w2": w2})
    # a game that is played already moves nothing: it is won with no chance
    to_come = [F.when(F.col("w1") + F.col("w2") <= k, F.col(f"p{k}")).otherwise(0.0) for k in range(4)]
    f = f.select("o_orderkey", "db", "w1", wins_pmf(to_come).alias("w"))
    worth = lambda x, i: x * F.when(F.col("w1") + i >= 3, 1.0).when(F.col("w1") + i == 2, F.col("db")).otherwise(0.0)
    return f.select("o_orderkey", F.round(F.aggregate(F.transform("w", worth), F.lit(0.0), lambda acc, x: acc + x), 9).alias("p"))


_WIN21 = f"(list_sum([{_COMB.format(n='20 + b', k='b')} * pow(p, 21) * pow(1 - p, b) for b in range(0, 20)]) + {_COMB.format(n='40', k='20')} * pow(p * (1 - p), 20) * p * p / (p * p + (1 - p) * (1 - p)))"


@query(f"""with s as (select s_nationkey team, s_suppkey, s_suppkey % 25 games, s_acctbal / 10000.0 v from supplier), u as (select team, avg(case when games >= 10 then v when games >= 2 then -0.07 + 0.9 * v end) m, count_if(games < 2) lacking from s group by team),
t as (select a.team a, b.team b, case when a.lacking + b.lacking = 0 then round_even({SIGMOID.format(x='0.42 * (a.m - b.m)')}, 4) end p from u a join u b on a.team < b.team)
select a, b, round(case when p is null then 0.5 else least(1 - 0.01059, greatest(0.01059, {_WIN21})) end, 9) p from t""")
def decider_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decider between rosters, from their mean values: measured, else imputed from a line, else unknown, which makes the decider even."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("team"), (F.col("s_suppkey") % 25).alias("games"), (F.col("s_acctbal") / 10000.0).alias("v"))
    value = F.when(F.col("games") >= 10, F.col("v")).when(F.col("games") >= 2, -0.07 + 0.9 * F.col("v"))
    teams = s.groupBy("team").agg(F.avg(value).alias("m"), F.count_if(F.col("games") < 2).alias("lacking"))
    a, b = (teams.select(F.col("team").alias(x), F.col("m").alias(f"m{x}"), F.col("lacking").alias(f"l{x}")) for x in "ab")
    pairs = a.join(b, F.col("a") < F.col("b"))
    p = F.bround(sigmoid(0.42 * (F.col("ma") - F.col("mb"))), 4)
    pairs = pairs.select("a", "b", F.when(F.col("la") + F.col("lb") == 0, p).alias("x"))
    priced = F.least(F.lit(1 - 0.01059), F.greatest(F.lit(0.01059), race_win(F.col("x"), 21)))
    return pairs.select("a", "b", F.round(F.when(F.col("x").isNull(), 0.5).otherwise(priced), 9).alias("p"))


@query("""with k as (select s_suppkey, (s_suppkey % 101) / 100.0 p from supplier), f as (select s_suppkey, p, (1 - 0.02118) * p + 0.01059 shown from k)
select s_suppkey, round(shown, 9) shown, case when round(p * 100) < 1 then '<1%' when round(p * 100) > 99 then '>99%' else cast(round(p * 100) as int) || '%' end said from f""")
def shown_chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = (F.col("s_suppkey") % 101) / 100.0
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(floored(p), 9).alias("shown"), percent(p).alias("said"))


@query(f"""with k as (select distinct (s_suppkey % 19 + 1) / 20.0 p from supplier), l as (select p, a, {_COMB.format(n='10 + a', k='a')} * pow(1 - p, 11) * pow(p, a) pr from k, range(0, 10) t(a)),
w as (select p, sum(pr) lost from l group by p) select l.p, cast(a as int) points, round(pr, 9) exact, round(sum(pr) over (partition by l.p order by a), 9) at_most, round(pr / lost, 9) of_losses from l join w using (p)""")
def loss_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Straight losses by the points made: each, that many or fewer, and the share of all straight losses."""
    from pyspark.sql.window import Window

    keys = table(spark, sf_dir, "supplier").select(((F.col("s_suppkey") % 19 + 1) / 20.0).alias("p")).distinct()
    lost = keys.select("p", F.inline(race_pmf(F.col("p"), F.lit(11)))).where("b = 11").select("p", F.col("a").cast("int").alias("points"), "prob")
    own = Window.partitionBy("p")
    return lost.select("p", "points", F.round("prob", 9).alias("exact"), F.round(F.sum("prob").over(own.orderBy("points")), 9).alias("at_most"), F.round(F.col("prob") / F.sum("prob").over(own), 9).alias("of_losses"))


@query(f"""with s as (select s_nationkey n, s_suppkey, s_acctbal / 10000.0 v, row_number() over (partition by s_nationkey order by s_acctbal desc, s_suppkey) r from supplier), t as (select n, max(case when r = 1 then v end) strong, max(case when r = 2 then v end) weak from s group by n),
m as (select n, strong, weak, lead(strong) over (order by n) os, lead(weak) over (order by n) ow from t where weak is not null), c as (select n, 'share' what, w x, 2 * ((1 - w) * weak + w * strong) - (os + ow - 0.1829 * abs(os - ow)) eta from m, (values (0.0), (0.40855), (0.5), (0.75), (1.0)) d(w) where os is not null
union all select n, 'frozen', k, 2 * (weak - k * 0.1) - (os + k * 0.1 + ow + k * 0.1 - 0.1829 * abs(os - ow)) from m, (values (0.0), (0.5), (1.0), (1.5), (2.0)) d(k) where os is not null), q as (select *, round_even({SIGMOID.format(x='eta')}, 4) p from c)
select n, what, cast(x as double) x, round(list_sum([{_COMB.format(n='10 + b', k='b')} * pow(p, 11) * pow(1 - p, b) for b in range(0, 10)]) + {_COMB.format(n='20', k='10')} * pow(p * (1 - p), 10) * p * p / (p * p + (1 - p) * (1 - p)), 8) win from q""")
def court_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What if the stronger player of a pair took more or less of the court, or were left out while values drift apart: a small table of what-ifs for each pair."""
    from pyspark.sql.window import Window

    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n"), (F.col("s_acctbal") / 10000.0).alias("v"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("r")).where("r <= 2")
    t = s.groupBy("n").agg(F.max(F.when(F.col("r") == 1, F.col("v"))).alias("strong"), F.max(F.when(F.col("r") == 2, F.col("v"))).alias("weak")).where("weak is not null")
    nxt = Window.orderBy("n")  # a row a nation
    m = t.select("*", F.lead("strong").over(nxt).alias("os"), F.lead("weak").over(nxt).alias("ow")).where("os is not null")
    others = lambda k: F.col("os") + F.col("ow") + 0.2 * k + GAMMA * F.abs(F.col("os") - F.col("ow"))
    share = [F.struct(F.lit("share").alias("what"), F.lit(w).alias("x"), (2 * ((1 - w) * F.col("weak") + w * F.col("strong")) - others(0.0)).alias("eta")) for w in (0.0, (1 + GAMMA) / 2, 0.5, 0.75, 1.0)]
    frozen = [F.struct(F.lit("frozen").alias("what"), F.lit(k).alias("x"), (2 * (F.col("weak") - 0.1 * k) - others(k)).alias("eta")) for k in (0.0, 0.5, 1.0, 1.5, 2.0)]
    rows = m.select("n", F.inline(F.array(*share, *frozen)))
    return rows.select("n", "what", F.round("x", 5).alias("x"), F.round(race_win(F.bround(sigmoid(F.col("eta")), 4), 11), 8).alias("win"))


@query(f"""with g as (select i, 0.01 + i * 0.001 p from range(0, 981) t(i)), w as (select i, list_sum([{_COMB.format(n='10 + b', k='b')} * pow(p, 11) * pow(1 - p, b) for b in range(0, 10)]) + {_COMB.format(n='20', k='10')} * pow(p * (1 - p), 10) * p * p / (p * p + (1 - p) * (1 - p)) win from g),
x as (select s_suppkey, 0.01 + 0.98 * ((s_suppkey * 7919) % 10007) / 10007.0 p from supplier), y as (select *, least(979, cast(floor((p - 0.01) / 0.001) as int)) i from x)
select s_suppkey, round(a.win + (b.win - a.win) * ((p - 0.01) / 0.001 - y.i), 8) win from y join w a on a.i = y.i join w b on b.i = y.i + 1""")
def grid_interpolated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The race's chance between the points of a grid of 981, which is broadcast."""
    grid = spark.range(981).select(F.col("id").cast("int").alias("i"), race_win(0.01 + F.col("id") * 0.001, 11).alias("win"))
    p = 0.01 + 0.98 * ((F.col("s_suppkey") * 7919) % 10007) / 10007.0
    x = table(spark, sf_dir, "supplier").select("s_suppkey", ((p - 0.01) / 0.001).alias("at")).withColumn("i", F.least(F.lit(979), F.floor("at").cast("int")))
    low, high = F.broadcast(grid), F.broadcast(grid.select((F.col("i") - 1).alias("i"), F.col("win").alias("above")))
    return x.join(low, "i").join(high, "i").select("s_suppkey", F.round(F.col("win") + (F.col("above") - F.col("win")) * (F.col("at") - F.col("i")), 8).alias("win"))


@query("""with s as (select s_suppkey, s_acctbal / 10000.0 a, (s_suppkey % 50) / 50.0 b from supplier) select s_suppkey, round(-ln(exp(-4 * a) + exp(-4 * b)) / 4, 9) softmin, round(sqrt(a * a + b * b), 9) hyp, round(ln(1 + abs(a)), 9) log1p from s""")
def soft_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lesser of two values without a corner, from the larger exponent down."""
    a, b = F.col("s_acctbal") / 10000.0, (F.col("s_suppkey") % 50) / 50.0
    low = F.least(a, b)
    soft = low - F.log1p(F.exp(-4 * F.abs(a - b))) / 4
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(soft, 9).alias("softmin"), F.round(F.hypot(a, b), 9).alias("hyp"), F.round(F.log1p(F.abs(a)), 9).alias("log1p"))


# SQL has no loops over states: tests/test_states.py holds these against plain recursions


@query(None)
def serve_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p, eta): where the serve-aware race starts with a published chance, for the chances in use."""
    return anchored(table(spark, sf_dir, "nation").select(((F.col("n_nationkey") % 9 + 1) / 10.0).alias("p")), 11)


@query(None)
def rally_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p, rally): the rally chance behind a decider's chance."""
    return rally_chance(table(spark, sf_dir, "supplier").select(((F.col("s_suppkey") % 19 + 1) / 20.0).alias("p")))


@query(None)
def mixed_serve_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The serve-aware race with an uncertain difference, for each pair of difference and deviation in use."""
    keys = table(spark, sf_dir, "nation").select((F.col("n_regionkey") / 5.0 - 0.4).alias("eta"), ((F.col("n_regionkey") % 2 + 1) / 10.0).alias("sd")).distinct()
    return mixed_serve_table(keys, 11)


@query(None)
def first_server_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What serving first is worth to side 0 of each match, by the match's own difference (0 between equals), for each target."""
    matches = log_rows(spark, sf_dir).select("match_id").distinct().withColumn("eta", match_eta(F.col("match_id")))
    start = lambda s: F.max(F.when(F.col("s") == s, F.col("v")))
    keys = matches.select("eta").union(spark.range(1).select(F.lit(0.0).alias("eta"))).distinct()
    tables = [serve_table(keys, t).where("a = 0 and b = 0 and s in ('A2', 'B2')").groupBy("eta").agg((start("A2") - start("B2")).alias("effect")).withColumn("target", F.lit(t)) for t in (11, 15)]
    effects = tables[0].unionByName(tables[1])
    equal = effects.where("eta = 0").select("target", F.col("effect").alias("between_equals"))
    return matches.join(F.broadcast(effects), "eta").join(F.broadcast(equal), "target").select("match_id", "eta", "target", "effect", "between_equals")


@query(None)
def decider_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deciders by their four rally chances: the chance with and without freeze, expected margin, expected rallies of each slot."""
    x = F.col("o_orderkey")
    ps = F.array(*((0.3 + 0.05 * (x % m)).cast("double") for m in (7, 5, 3, 8)))
    return deciders(table(spark, sf_dir, "orders").select(F.transform(ps, lambda p: F.round(p, 6)).alias("ps")))


def log_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """match_id, log_index, rally, eta, a, b, s: the state at the start of each rally that the log tells readably, from side 0; eta is the match's own difference, to a tenth."""
    from pyspark.sql.window import Window

    said = F.split("start_string", "-")
    n = lambda i: F.try_element_at(said, F.lit(i)).try_cast("int")
    rows = log_rows(spark, sf_dir).where(F.col("log_type") == RALLY).select("match_id", "log_index", "server_side", n(1).alias("own"), n(2).alias("other"), n(3).alias("number")).where("own is not null and other is not null and number is not null")
    first = F.col("server_side") == 0
    at = rows.select(
        "match_id", "log_index", F.when(first, F.col("own")).otherwise(F.col("other")).alias("a"), F.when(first, F.col("other")).otherwise(F.col("own")).alias("b"),
        F.concat(F.when(first, "A").otherwise("B"), F.when(F.col("number") == 1, "1").otherwise("2")).alias("s"), F.row_number().over(Window.partitionBy("match_id").orderBy("log_index")).alias("rally"))
    return at.withColumn("eta", match_eta(F.col("match_id")))


@query(None)
def log_win_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Side 0's chance at the start of each rally that the log tells readably, by the match's own difference: its players' ratings, to a tenth.

    Players are rated from -0.5 to 0.5, so there are 41 differences at most and 41 x 676 states, which are broadcast.
    """
    at = log_states(spark, sf_dir)
    states = serve_table(at.select("eta").distinct(), 11).select("eta", "a", "b", "s", "v")
    return at.join(F.broadcast(states), ["eta", "a", "b", "s"], "left").select("match_id", "log_index", "rally", "eta", "a", "b", "s", F.coalesce("v", F.lit(0.5)).alias("p"))


def match_gap(match_id):
    """A match's difference in logits: users 4m and 4m + 1 against the next two."""
    return sum((s * rating(match_id * 4 + i) for i, s in enumerate((1, 1, -1, -1))), F.lit(0.0))


def match_eta(match_id):
    """The same in tenths of a logit, for tables of few differences."""
    return F.round(match_gap(match_id), 1) + 0.0
