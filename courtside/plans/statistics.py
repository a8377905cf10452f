"""Regressions, ranks and tests, as sums that Spark combines."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.registry import query
from courtside.operators.ranks import ranked, ranked_within
from courtside.functions.probability import NORMAL_CDF, normal_cdf
from courtside.sources.storage import written
from courtside.sources.tables import GAMES, SLOTS, games, slots, table

_PER = "per as (select player, count(*) n, avg(pf) x, avg(pf - pa) y from slots group by player)"


def _per_player(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots(games(spark, sf_dir)).groupBy("player").agg(F.count("*").alias("n"), F.avg("pf").alias("x"), F.avg(F.col("pf") - F.col("pa")).alias("y"))


@query(f"""with {GAMES}, {SLOTS}, {_PER}, m as (select sum(n * x) / sum(n) mx, sum(n * y) / sum(n) my from per), f as (select sum(n * (x - mx) * (y - my)) / sum(n * (x - mx) * (x - mx)) b, any_value(mx) mx, any_value(my) my from per, m)
select player, round(y - (my + b * (x - mx)), 6) resid, row_number() over (order by round(y - (my + b * (x - mx)), 6) desc, player) place from per, f""")
def wls_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each player's result beside a weighted line through all: five sums in one row."""
    per = written(_per_player(spark, sf_dir), "players")
    s = per.agg(*(F.sum(F.expr(e)).alias(a) for a, e in {"sn": "n", "sx": "n * x", "sy": "n * y", "sxx": "n * x * x", "sxy": "n * x * y"}.items()))  # one row
    line = s.select((F.col("sx") / F.col("sn")).alias("mx"), (F.col("sy") / F.col("sn")).alias("my"), F.expr("(sxy - sx * sy / sn) / (sxx - sx * sx / sn)").alias("b"))
    left = per.join(F.broadcast(line)).select("player", F.round(F.expr("y - (my + b * (x - mx))"), 6).alias("resid"))
    return ranked(left.withColumn("down", -F.col("resid")), ["down", "player"], "place").drop("down")


@query(f"with {GAMES} select context, round(corr(s1, s2), 6) r, round(corr(game_no, abs(margin)), 6) r_late from games group by context")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = games(spark, sf_dir).withColumn("apart", F.abs("margin"))
    return g.groupBy("context").agg(F.round(F.corr("s1", "s2"), 6).alias("r"), F.round(F.corr("game_no", "apart"), 6).alias("r_late"))


@query("""with r as (select c_mktsegment, row_number() over (partition by c_mktsegment order by c_acctbal, c_custkey) a, row_number() over (partition by c_mktsegment order by c_nationkey, c_custkey) b from customer)
select c_mktsegment, round(1 - 6 * sum((a - b) * (a - b)) / (count(*) * (count(*) * count(*) - 1.0)), 8) rho from r group by c_mktsegment""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal", "c_nationkey")
    r = ranked_within(ranked_within(own, ["c_mktsegment"], ["c_acctbal", "c_custkey"], "a"), ["c_mktsegment"], ["c_nationkey", "c_custkey"], "b")
    n = F.count("*")
    return r.groupBy("c_mktsegment").agg(F.round(1 - 6 * F.sum(F.expr("(a - b) * (a - b)")) / (n * (n * n - F.lit(1.0))), 8).alias("rho"))


@query(f"with {GAMES}, {SLOTS} select player, round(case when var_pop(game_no) > 1e-9 then covar_pop(pf - pa, game_no) / var_pop(game_no) end, 6) slope from slots group by player having count(*) >= 60")
def group_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each player's trend over a match, none where the games don't vary."""
    s = slots(games(spark, sf_dir)).withColumn("d", F.col("pf") - F.col("pa"))
    per = s.groupBy("player").agg(F.covar_pop("d", "game_no").alias("c"), F.var_pop("game_no").alias("v"), F.count("*").alias("n")).where("n >= 60")
    return per.select("player", F.round(F.when(F.col("v") > 1e-9, F.col("c") / F.col("v")), 6).alias("slope"))


_Z = f"""{_PER}, z as (select player, y / (9.0 / sqrt(n)) z from per), p as (select player, z, 1 - {NORMAL_CDF.format(x='z')} p from z)"""


def _p_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = _per_player(spark, sf_dir).select("player", (F.col("y") / (9.0 / F.sqrt("n"))).alias("z"))
    return z.select("player", "z", (1 - normal_cdf(F.col("z"))).alias("p"))


@query(f"""with {GAMES}, {SLOTS}, {_Z}, r as (select player, p, row_number() over (order by p, player) k, count(*) over () m from p), c as (select coalesce(max(k) filter (where p <= 0.1 * k / m), 0) cut from r)
select player, cast(k <= cut as int) fdr10, cast(p <= 0.05 / m as int) bonferroni from r, c""")
def bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the players stand out, at a false discovery rate of a tenth, and by Bonferroni; one row a player is ranked."""
    p = _p_values(spark, sf_dir)
    placed = ranked(p, ["p", "player"], "k").withColumn("m", F.lit(p.count()))
    cut = placed.agg(F.coalesce(F.max(F.when(F.expr("p <= 0.1D * k / m"), F.col("k"))), F.lit(0)).alias("cut")).first().cut
    return placed.withColumn("cut", F.lit(cut)).select("player", F.expr("cast(k <= cut as int)").alias("fdr10"), F.expr("cast(p <= 0.05D / m as int)").alias("bonferroni"))


@query(f"""with {GAMES}, {SLOTS}, {_Z}, t(cut) as (values (1.0), (1.645), (2.0), (2.5)) select cast(cut as double) cut, count(*) filter (where z > cut) seen, round(count(*) * (1 - {NORMAL_CDF.format(x='cut')}), 4) expected from t, p group by cut""")
def tail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = spark.createDataFrame([(x,) for x in (1.0, 1.645, 2.0, 2.5)], "cut double")
    both = _p_values(spark, sf_dir).select("z", F.explode(F.array(*map(F.lit, (1.0, 1.645, 2.0, 2.5)))).alias("cut"))
    seen = both.groupBy("cut").agg(F.count_if(F.col("z") > F.col("cut")).alias("seen"), F.count("*").alias("n"))
    return cuts.join(seen, "cut").select("cut", "seen", F.round(F.col("n") * (1 - normal_cdf(F.col("cut"))), 4).alias("expected"))


@query(f"""with {GAMES}, {SLOTS}, {_Z}, r as (select z, row_number() over (order by z, player) k, count(*) over () m, {NORMAL_CDF.format(x='z')} f from p) select round(max(greatest(abs(k / m - f), abs((k - 1) / m - f))), 6) d, count(*) n, round(least(1.0, 2 * sum_p), 6) p from r, (select sum((case when j % 2 = 1 then 1 else -1 end) * exp(-2 * j * j * power((sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d, 2))) sum_p from range(1, 101) t(j), (select round(max(greatest(abs(k / m - f), abs((k - 1) / m - f))), 6) d, count(*) n from r)) group by sum_p""")
def ks_normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kolmogorov and Smirnov's distance of the players' scores from the normal distribution."""
    p = _p_values(spark, sf_dir)
    r = ranked(p, ["z", "player"], "k").withColumn("m", F.lit(p.count())).withColumn("f", normal_cdf(F.col("z")))
    far = r.agg(F.round(F.max(F.greatest(F.abs(F.expr("k / m - f")), F.abs(F.expr("(k - 1) / m - f")))), 6).alias("d"), F.count("*").alias("n"))
    # the distance's chance by Kolmogorov's series, with the usual correction for small samples
    scaled = (F.sqrt("n") + 0.12 + 0.11 / F.sqrt("n")) * F.col("d")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, j: acc + F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * scaled * scaled))
    return far.select("d", "n", F.round(F.least(F.lit(1.0), 2 * series), 6).alias("p"))


@query(f"""with {GAMES}, {SLOTS}, h as (select player, dense_rank() over (partition by player order by match_id) % 2 half, pf - pa d from slots), s as (select player, avg(d) filter (where half = 0) a, avg(d) filter (where half = 1) b, count(*) n from h group by player)
select round(corr(a, b), 6) r, count(*) n from s where n >= 60""")
def split_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do players' results in alternate matches agree?"""
    half = F.dense_rank().over(Window.partitionBy("player").orderBy("match_id")) % 2
    h = slots(games(spark, sf_dir)).select("player", half.alias("half"), (F.col("pf") - F.col("pa")).alias("d"))
    s = h.groupBy("player").agg(F.avg(F.when(F.col("half") == 0, F.col("d"))).alias("a"), F.avg(F.when(F.col("half") == 1, F.col("d"))).alias("b"), F.count("*").alias("n")).where("n >= 60")
    return s.agg(F.round(F.corr("a", "b"), 6).alias("r"), F.count("*").alias("n"))


@query("select c_nationkey, list_sort(list(c_acctbal))[count(*) // 4 + 1] q from customer group by c_nationkey")
def quartile_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The value at a quarter of the sorted group, by ranks rather than a list of the group."""
    r = ranked_within(table(spark, sf_dir, "customer").select("c_nationkey", "c_acctbal", "c_custkey"), ["c_nationkey"], ["c_acctbal", "c_custkey"], "k", "n")
    return r.where("k = n div 4 + 1").select("c_nationkey", F.col("c_acctbal").alias("q"))


@query(f"""with {GAMES}, d as (select a1, match_id, target - avg(target) over (partition by a1) x, margin - avg(margin) over (partition by a1) y from games),
b as (select sum(x * y) / sum(x * x) slope, sum(x * x) xx from d), e as (select match_id, sum(x * (y - slope * x)) s from d, b group by match_id)
select round(any_value(slope), 6) slope, round(sqrt(sum(s * s) * count(*) / (count(*) - 1.0)) / any_value(xx), 6) se from e, b""")
def fixed_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin on target within players (their means taken out), with an error robust to clusters of a match."""
    own = games(spark, sf_dir).groupBy("a1").agg(F.avg("target").alias("mx"), F.avg("margin").alias("my"))
    d = games(spark, sf_dir).join(own, "a1").select("match_id", (F.col("target") - F.col("mx")).alias("x"), (F.col("margin") - F.col("my")).alias("y"))
    b = d.agg((F.sum(F.expr("x * y")) / F.sum(F.expr("x * x"))).alias("slope"), F.sum(F.expr("x * x")).alias("xx"))  # one row
    e = d.join(F.broadcast(b)).groupBy("match_id").agg(F.sum(F.expr("x * (y - slope * x)")).alias("s"), F.first("slope").alias("slope"), F.first("xx").alias("xx"))
    n = F.count("*")
    return e.agg(F.round(F.first("slope"), 6).alias("slope"), F.round(F.sqrt(F.sum(F.expr("s * s")) * n / (n - F.lit(1.0))) / F.first("xx"), 6).alias("se"))
