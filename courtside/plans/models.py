"""Fits, forecast comparisons, resampling and simulation. Random draws are hashes of (draw, row), so that a rerun gives the same."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.registry import query
from courtside.functions.probability import SIGMOID, logit, sigmoid
from courtside.operators.fits import logistic_newton, paired_map
from courtside.operators.resampling import dealt_covariances, resampled_sums
from courtside.plans.aggregates import FORECASTS, forecasts
from courtside.sources.tables import GAMES, games, table

_GRID = "g as (select i * 0.05 b, j * 0.04 a from range(14, 46) t(i), range(-10, 11) u(j))"


@query(f"""with {FORECASTS}, d as (select round(ln(p / (1 - p)), 6) x, sum(y) won, count(*) n from fc group by 1), {_GRID},
s as (select a, b, -sum(won * ln({SIGMOID.format(x='a + b * x')}) + (n - won) * ln(1 - {SIGMOID.format(x='a + b * x')})) nll from d, g group by a, b)
select round(arg_min(a, struct_pack(n := round(nll, 6), b := b, a := a)), 2) a, round(arg_min(b, struct_pack(n := round(nll, 6), b := b, a := a)), 2) b, round(min(nll), 4) nll from s""", a="double", b="double")
def calibration_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best (a, b) of a grid: games are reduced to distinct logits first, then each meets all of the fixed grid."""
    d = forecasts(spark, sf_dir).groupBy(F.round(logit(F.col("p")), 6).alias("x")).agg(F.sum("y").alias("won"), F.count("*").alias("n"))
    grid = d.select("*", F.explode(F.sequence(F.lit(14), F.lit(45))).alias("i")).select("*", F.explode(F.sequence(F.lit(-10), F.lit(10))).alias("j")).withColumns({"b": F.col("i") * 0.05, "a": F.col("j") * 0.04})
    p = sigmoid(F.col("a") + F.col("b") * F.col("x"))
    s = grid.groupBy("a", "b").agg((-F.sum(F.col("won") * F.ln(p) + (F.col("n") - F.col("won")) * F.ln(1 - p))).alias("nll"))
    best = F.struct(F.round("nll", 6), F.col("b"), F.col("a"))
    return s.agg(F.round(F.min_by("a", best), 2).alias("a"), F.round(F.min_by("b", best), 2).alias("b"), F.round(F.min("nll"), 4).alias("nll"))


_STRATEGIES = """st as (select gid, y, 'rated' strategy, p from fc union all select gid, y, 'coin', 0.5 from fc union all select gid, y, 'shrunk', 1 / (1 + exp(-0.5 * ln(p / (1 - p)))) from fc union all select gid, y, 'home', 0.55 from fc)"""


def _strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    fc = forecasts(spark, sf_dir)
    rows = {"rated": F.col("p"), "coin": F.lit(0.5), "shrunk": sigmoid(0.5 * logit(F.col("p"))), "home": F.lit(0.55)}
    return fc.select("gid", "y", F.inline(F.array(*(F.struct(F.lit(k).alias("strategy"), v.alias("p")) for k, v in rows.items()))))


@query(f"with {FORECASTS}, {_STRATEGIES} select strategy, count(*) n, round(avg(cast((p >= 0.5) = (y = 1) as int)), 6) accuracy, round(avg((p - y) * (p - y)), 6) brier from st group by strategy")
def strategy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All strategies on the same games: long rows (strategy, game, p) and one aggregate."""
    return _strategies(spark, sf_dir).groupBy("strategy").agg(F.count("*").alias("n"), F.round(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int")), 6).alias("accuracy"), F.round(F.avg(F.expr("(p - y) * (p - y)")), 6).alias("brier"))


@query(f"with {FORECASTS}, {_STRATEGIES} select gid, round({SIGMOID.format(x='avg(ln(p / (1 - p)))')}, 8) p from st group by gid")
def ensemble_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _strategies(spark, sf_dir).groupBy("gid").agg(F.avg(logit(F.col("p"))).alias("x")).select("gid", F.round(sigmoid(F.col("x")), 8).alias("p"))


_DRAW = "cast('0x' || substr(md5({key}), 1, 8) as bigint) / 4294967296.0"


def draw(*parts):
    """Uniform in [0, 1), fixed by the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


_M = 2147483648


def mixed(key, rep):
    """A whole number below 2^31, fixed by a whole key below 2^31 and a repetition: products and shifts, as quick as it must be for thousands of repetitions."""
    x = (key * 1597334677 + rep * 1812433253) % _M
    for shift, factor in ((15, 1540483477), (13, 1103515245)):
        x = x.bitwiseXOR(F.shiftright(x, shift)) * factor % _M
    return x.bitwiseXOR(F.shiftright(x, 16))


_POISSON = [(0.3678794, 0), (0.7357589, 1), (0.9196986, 2), (0.9810118, 3), (0.9963402, 4)]
_POISSON_SQL = "case " + " ".join(f"when u < {c} then {k}" for c, k in _POISSON) + " else 5 end"


def _mixed_sql(source: str, key: str) -> str:
    """Adds u, uniform in [0, 1), to the rows of source, which has rep."""
    return f"""(select * exclude (h0, h1, h2), xor(h2, h2 >> 16) / 2147483648.0 u from (select *, (xor(h1, h1 >> 13) * 1103515245) % 2147483648 h2 from (select *, (xor(h0, h0 >> 15) * 1540483477) % 2147483648 h1 from
    (select *, (cast({key} as bigint) % 2147483648 * 1597334677 + cast(rep as bigint) * 1812433253) % 2147483648 h0 from {source}))))"""


@query(f"""with {FORECASTS}, m as (select match_id, sum((p - y) * (p - y) - 0.25) d, count(*) n from fc group by match_id), r as (select unnest(range(0, 4000)) rep), mr as (select * from m, r),
w as (select rep, d, n, {_POISSON_SQL} k from {_mixed_sql('mr', 'match_id')}), b as (select rep, sum(k * d) / sum(k * n) diff from w group by rep), o as (select diff, row_number() over (order by diff) i from b)
select count(*) reps, round(avg(diff), 6) mean, round(max(diff) filter (where i = 101), 6) lo, round(max(diff) filter (where i = 3900), 6) hi, round(avg(cast(diff < 0 as int)), 4) better from o""")
def paired_bootstrap(spark: SparkSession, sf_dir: str, reps: int = 4000) -> DataFrame:
    """The rated forecast's Brier score less a coin's, over Poisson-weighted resamples of whole matches: mean, the middle 95 of 100, and how often it is better."""
    m = forecasts(spark, sf_dir).groupBy("match_id").agg(F.sum(F.expr("(p - y) * (p - y) - 0.25D")).alias("d"), F.count("*").alias("n"))
    b = resampled_sums(m, "match_id", [], ["d", "n"], reps).select((F.col("d") / F.col("n")).alias("diff"))
    o = b.withColumn("i", F.row_number().over(Window.orderBy("diff")))  # a row a repetition
    end = lambda k: F.round(F.max(F.when(F.col("i") == k, F.col("diff"))), 6)
    cut = reps // 40
    return o.agg(F.count("*").alias("reps"), F.round(F.avg("diff"), 6).alias("mean"), end(cut + 1).alias("lo"), end(reps - cut).alias("hi"), F.round(F.avg((F.col("diff") < 0).cast("int")), 4).alias("better"))


@query(f"""with {GAMES}, d as (select gid, match_id * 8 + game_no key, a1, game_no x, margin y, row_number() over (partition by a1 order by gid, margin) i from games), r as (select unnest(range(0, 200)) rep), dr as (select rep, gid, key, a1, y from d, r),
s as (select rep, a1, y, row_number() over (partition by rep, a1 order by u, gid, y) i from {_mixed_sql('dr', 'key')}), j as (select rep, a1, d.x, s.y from s join d using (a1, i))
select a1, round(stddev_samp(c), 5) null_sd from (select rep, a1, avg(x * y) - avg(x) * avg(y) c from j group by all) group by a1""")
def permutation_null(spark: SparkSession, sf_dir: str, reps: int = 200) -> DataFrame:
    """Spread of a player's covariance when results are dealt anew among that player's games."""
    own = games(spark, sf_dir).select("gid", (F.col("match_id") * 8 + F.col("game_no")).alias("key"), "a1", F.col("game_no").alias("x"), F.col("margin").alias("y"))
    d = own.withColumn("i", F.row_number().over(Window.partitionBy("a1").orderBy("gid", "y")))
    c = dealt_covariances(d, "a1", reps)
    return c.groupBy("a1").agg(F.round(F.stddev_samp("c"), 5).alias("null_sd"))


@query(f"""with p as (select s_suppkey, s_acctbal / 2000.0 v from supplier order by s_acctbal desc, s_suppkey limit 12), s as (select unnest(range(0, 2000)) sim),
x as (select sim, s_suppkey, v + 4 * {_DRAW.format(key="sim || ':' || s_suppkey")} z from p, s), r as (select s_suppkey, row_number() over (partition by sim order by z desc, s_suppkey) k from x)
select s_suppkey, round(avg(cast(k = 1 as int)), 6) p_first, round(avg(cast(k <= 3 as int)), 6) p_top3 from r group by s_suppkey""")
def rank_simulation(spark: SparkSession, sf_dir: str, sims: int = 2000) -> DataFrame:
    """How often each of the top twelve comes first or in the first three when values are noisy."""
    top = table(spark, sf_dir, "supplier").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(12).select("s_suppkey", (F.col("s_acctbal") / 2000.0).alias("v"))
    x = top.select("*", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("sim")).withColumn("z", F.col("v") + 4 * draw("sim", "s_suppkey"))
    k = F.row_number().over(Window.partitionBy("sim").orderBy(F.desc("z"), "s_suppkey"))
    r = x.select("s_suppkey", k.alias("k"))
    return r.groupBy("s_suppkey").agg(F.round(F.avg((F.col("k") == 1).cast("int")), 6).alias("p_first"), F.round(F.avg((F.col("k") <= 3).cast("int")), 6).alias("p_top3"))


@query(f"""with n as (select n_nationkey id, n_regionkey pool from nation), f as (select a.pool, a.id a, b.id b, {SIGMOID.format(x='(a.id - b.id) / 10.0')} p from n a join n b on a.pool = b.pool and a.id < b.id), s as (select unnest(range(0, 500)) sim),
g as (select sim, pool, a, b, {_DRAW.format(key="sim || ':' || a || ':' || b")} < p won from f, s), w as (select sim, pool, a id, cast(won as int) w from g union all select sim, pool, b, cast(not won as int) from g),
t as (select sim, pool, id, sum(w) wins from w group by all), r as (select pool, id, row_number() over (partition by sim, pool order by wins desc, md5(sim || ':' || id)) k from t)
select pool, id, round(avg(cast(k = 1 as int)), 6) title from r group by all""")
def season_race(spark: SparkSession, sf_dir: str, sims: int = 500) -> DataFrame:
    """A round robin played out many times; ties by lot."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("pool"))
    f = n.withColumnRenamed("id", "a").join(n.withColumnRenamed("id", "b"), "pool").where("a < b")
    g = f.select("*", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("sim")).withColumn("won", (draw("sim", "a", "b") < sigmoid((F.col("a") - F.col("b")) / 10.0)).cast("int"))
    w = g.select("sim", "pool", F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("won").alias("w")), F.struct(F.col("b").alias("id"), (1 - F.col("won")).alias("w")))))
    t = w.groupBy("sim", "pool", "id").agg(F.sum("w").alias("wins"))
    k = F.row_number().over(Window.partitionBy("sim", "pool").orderBy(F.desc("wins"), F.md5(F.concat_ws(":", "sim", "id"))))
    return t.select("pool", "id", k.alias("k")).groupBy("pool", "id").agg(F.round(F.avg((F.col("k") == 1).cast("int")), 6).alias("title"))


@query(None)
def singles_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of players from who beat whom, with a normal prior: fitted by gradient steps whose sums Spark makes."""
    met = games(spark, sf_dir).groupBy("a1", "b1").agg(F.sum((F.col("margin") > 0).cast("int")).alias("won"), F.count("*").alias("n"))
    return paired_map(met.select(F.col("a1").alias("a"), F.col("b1").alias("b"), "won", "n"))


@query(None)
def imputation_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A three-parameter logistic fit by Newton steps, with standard errors."""
    fc = forecasts(spark, sf_dir).select("y", F.array(F.lit(1.0), logit(F.col("p")), (F.col("tour") == "MLP").cast("double")).alias("x"))
    return logistic_newton(fc, ["intercept", "rated", "mlp"])
