"""Chances of races, series and fixtures."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtside.registry import query
from courtside.functions.probability import NORMAL_CDF, SIGMOID, best_of, calibrated, normal_cdf, race_pmf, race_win, sigmoid, wins_pmf
from courtside.operators.serve import leverage, rally_race, serve_table
from courtside.plans.aggregates import FORECASTS, forecasts
from courtside.sources.tables import table

# n over k as a product, for the oracles
_COMB = "list_reduce(list_prepend(1.0, [(({n}) - ({k}) + i) / i for i in range(1, ({k}) + 1)]), lambda x, y: x * y)"
_P = "(s_suppkey % 19 + 1) / 20.0"


def _chances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chance and target for each supplier; kernels are computed once for each distinct pair and joined back (memo)."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", ((F.col("s_suppkey") % 19 + 1) / 20.0).alias("p"), F.when(F.col("s_nationkey") % 2 == 0, 11).otherwise(15).alias("t"))


_KEYS = f"k as (select distinct {_P} p, case when s_nationkey % 2 = 0 then 11 else 15 end t from supplier)"


@query(f"""with {_KEYS}, l as (select p, t, unnest(range(0, t - 1)) b from k),
e as (select p, t, t a, b, {_COMB.format(n='t - 1 + b', k='b')} * pow(p, t) * pow(1 - p, b) prob from l union all select p, t, b, t, {_COMB.format(n='t - 1 + b', k='b')} * pow(1 - p, t) * pow(p, b) from l
union all select p, t, t - 1, t - 1, {_COMB.format(n='2 * t - 2', k='t - 1')} * pow(p * (1 - p), t - 1) from k)
select p, t, cast(a as int) a, cast(b as int) b, round(prob, 9) prob from e""")
def race_pmf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact scores of a race, for each chance and target in use."""
    keys = _chances(spark, sf_dir).select("p", "t").distinct()
    return keys.select("p", "t", F.inline(race_pmf(F.col("p"), F.col("t")))).withColumn("prob", F.round("prob", 9))


_WIN = f"(list_sum([{_COMB.format(n='t - 1 + b', k='b')} * pow(p, t) * pow(1 - p, b) for b in range(0, t - 1)]) + {_COMB.format(n='2 * t - 2', k='t - 1')} * pow(p * (1 - p), t - 1) * p * p / (p * p + (1 - p) * (1 - p)))"


@query(f"""with {_KEYS}, w as (select p kp, t kt, {_WIN} w from k) select s_suppkey, round(w, 9) win from supplier join w on kp = {_P} and kt = case when s_nationkey % 2 = 0 then 11 else 15 end""")
def race_win_memo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct arguments, the kernel, and back: no row computes what another has."""
    rows = _chances(spark, sf_dir)
    memo = rows.select("p", "t").distinct().withColumn("win", F.round(race_win(F.col("p"), F.col("t")), 9))
    return rows.join(memo, ["p", "t"]).select("s_suppkey", "win")


_WIN_OF = f"(list_sum([{_COMB.format(n='10 + b', k='b')} * pow(p, 11) * pow(1 - p, b) for b in range(0, 10)]) + {_COMB.format(n='20', k='10')} * pow(p * (1 - p), 10) * p * p / (p * p + (1 - p) * (1 - p)))"


@query(f"""with n as (select unnest(range(-20, 21)) i), z as (select i * 0.2 z, exp(-0.5 * i * 0.2 * i * 0.2) w from n), a as (select s_suppkey, s_acctbal / 20000.0 eta, (s_suppkey % 5 + 1) / 10.0 sd from supplier),
x as (select s_suppkey, w, round_even({SIGMOID.format(x='eta + sd * z')}, 4) p from a, z), m as (select p, {_WIN_OF} win from (select distinct p from x))
select s_suppkey, round(sum(w * win) / sum(w), 8) p from x join m using (p) group by s_suppkey""")
def race_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A race's chance averaged over a normal difference, at 41 nodes out to four deviations; kernels once for each chance of four digits (at most 10,001)."""
    z = F.col("i") * F.lit(0.2)
    nodes = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 20000.0).alias("eta"), ((F.col("s_suppkey") % 5 + 1) / 10.0).alias("sd"), F.explode(F.sequence(F.lit(-20), F.lit(20))).alias("i"))
    nodes = nodes.select("s_suppkey", F.exp(-0.5 * z * z).alias("w"), F.bround(sigmoid(F.col("eta") + F.col("sd") * z), 4).alias("p"))
    memo = nodes.select("p").distinct().withColumn("win", race_win(F.col("p"), 11))
    return nodes.join(F.broadcast(memo), "p").groupBy("s_suppkey").agg(F.round(F.sum(F.col("w") * F.col("win")) / F.sum("w"), 8).alias("p"))


@query(f"with {FORECASTS} select gid, round((1 - 0.02118) * {SIGMOID.format(x='0.06 + 0.9 * ln(p / (1 - p))')} + 0.01059, 8) q from fc")
def calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecasts(spark, sf_dir).select("gid", F.round(calibrated(F.col("p")), 8).alias("q"))


@query(f"with k as (select s_suppkey, {_P} p from supplier) select s_suppkey, round(p * p * (3 - 2 * p), 9) of3, round(p * p * p * (10 - 15 * p + 6 * p * p), 9) of5 from k")
def best_of_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _chances(spark, sf_dir)
    return rows.select("s_suppkey", F.round(best_of(F.col("p"), 3), 9).alias("of3"), F.round(best_of(F.col("p"), 5), 9).alias("of5"))


def _fixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda m: (F.col("o_orderkey") % m + 1) / F.lit(m + 1.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", *(r(m).alias(f"p{k}") for k, m in enumerate((7, 11, 13, 17))), r(5).alias("db"))


@query("""with f as (select o_orderkey, (o_orderkey % 7 + 1) / 8.0 p0, (o_orderkey % 11 + 1) / 12.0 p1, (o_orderkey % 13 + 1) / 14.0 p2, (o_orderkey % 17 + 1) / 18.0 p3, (o_orderkey % 5 + 1) / 6.0 db from orders),
x as (select o_orderkey, db, a + b + c + d w, (case a when 1 then p0 else 1 - p0 end) * (case b when 1 then p1 else 1 - p1 end) * (case c when 1 then p2 else 1 - p2 end) * (case d when 1 then p3 else 1 - p3 end) pr
from f, range(2) ta(a), range(2) tb(b), range(2) tc(c), range(2) td(d))
select o_orderkey, round(sum(case when w = 4 then pr else 0 end), 9) p40, round(sum(case when w = 3 then pr else 0 end), 9) p31, round(sum(case when w = 2 then pr else 0 end), 9) p_db, round(sum(case when w = 1 then pr else 0 end), 9) p13, round(sum(case when w = 0 then pr else 0 end), 9) p04,
round(least(1 - 0.01059, greatest(0.01059, sum(case when w > 2 then pr when w = 2 then pr * db else 0 end))), 9) p_win from x group by o_orderkey""")
def matchup_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four games and a decider: the games' wins are folded in one by one; the chance stays clear of 0 and 1."""
    f = _fixtures(spark, sf_dir).select("o_orderkey", "db", wins_pmf([F.col(f"p{k}") for k in range(4)]).alias("w"))
    win = F.col("w")[4] + F.col("w")[3] + F.col("w")[2] * F.col("db")
    names = {"p40": 4, "p31": 3, "p_db": 2, "p13": 1, "p04": 0}
    return f.select("o_orderkey", *(F.round(F.col("w")[k], 9).alias(n) for n, k in names.items()), F.round(F.least(F.lit(1 - 0.01059), F.greatest(F.lit(0.01059), win)), 9).alias("p_win"))


@query(f"""with r as (select s_suppkey, s_nationkey, s_acctbal / 4000.0 v, lead(s_acctbal) over (partition by s_nationkey order by s_acctbal desc, s_suppkey) / 4000.0 nxt from supplier)
select s_suppkey, round({NORMAL_CDF.format(x='(v - nxt) / sqrt(0.5)')}, 6) truly from r where nxt is not null""")
def second_seat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How surely a ranked one is better than the next, both values being uncertain."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    r = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 4000.0).alias("v"), (F.lead("s_acctbal").over(w) / 4000.0).alias("nxt")).where("nxt is not null")
    return r.select("s_suppkey", F.round(normal_cdf((F.col("v") - F.col("nxt")) / F.sqrt(F.lit(0.5))), 6).alias("truly"))


@query(None)
def serve_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The serve-aware race's chance in every score and serving state, for each pair of serving chances in use."""
    keys = table(spark, sf_dir, "supplier").select(((F.col("s_nationkey") % 5) / 5.0 - 0.4).alias("eta")).distinct()
    return serve_table(keys, 11)


@query(None)
def biggest_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The states between equals in which a rally moves the chance most: a top-k report."""
    return leverage(serve_states(spark, sf_dir).where("abs(eta) < 1e-9")).orderBy(F.desc("swing"), "a", "b", "s").limit(6)


@query(None)
def rally_race_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rally_race(_chances(spark, sf_dir).select("p").distinct(), 21)
