"""Fits over whole games: refits of structures and levels, fixed effects, and many logistic fits at once."""
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.registry import query
from courtside.functions.probability import logit, normal_cdf, race_win, race_win_known, sigmoid
from courtside.operators import effects, refits, simplex
from courtside.operators.fits import keyed_newton
from courtside.operators.resampling import resampled_sums
from courtside.plans.aggregates import forecasts
from courtside.sources.storage import written
from courtside.sources.tables import games, rating

SPLIT = "1996-01-01"


@query(None)
def map_refits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Players' most likely values under each structure of a pair and each level of what is observed."""
    values, _ = refits.refitted(refits.observations(games(spark, sf_dir).where("not is_forfeit")))
    return values


@query(None)
def refit_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each refit of the games before a day forecasts those from it on, where all four players have values; matches and games by a logit, points by the race, margins by the normal."""
    g = written(games(spark, sf_dir).where("not is_forfeit").select("match_id", "game_no", "date", *refits.SIDES, "s1", "s2", "target", "margin"), "games")
    values, _ = refits.refitted(refits.observations(g.where(F.col("date") < SPLIT)))
    later = refits.forecast(g.where(F.col("date") >= SPLIT), written(values, "values"))
    later = later.withColumn("rally", sigmoid(F.col("eta")))
    p = F.when(F.col("level") == "points", race_win_known(F.col("rally"), F.col("target"))).when(F.col("level") == "margin", normal_cdf(F.col("eta") / F.exp("log_spread"))).otherwise(sigmoid(F.col("eta")))
    f = later.select("fit", p.alias("p"), (F.col("margin") > 0).cast("int").alias("y"))
    return f.groupBy("fit").agg(F.count("*").alias("n"), F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("int")).alias("accuracy"), F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))


#: A game's effects: its players for and against, and the level of its tour.
SLOTS = {"a1": 1, "a2": 1, "b1": -1, "b2": -1, "tour_level": 1}


@query(None)
def two_way_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin on target and on game number beside effects of all players and tours, with errors robust to clusters of a match."""
    g = games(spark, sf_dir).withColumn("tour_level", F.when(F.col("tour") == "MLP", -1).otherwise(-2).cast("long"))
    return effects.within_regression(g, SLOTS, "margin", ("target", "game_no"), "match_id")


def _cells(fc: DataFrame, *keys: str) -> DataFrame:
    """Forecast games as cells of (1, rated logit, whether of the league)."""
    x = {"x0": F.lit(1.0), "x1": F.round(logit(F.col("p")), 6), "x2": (F.col("tour") == "MLP").cast("double")}
    return fc.select(*keys, "y", *(v.alias(k) for k, v in x.items())).groupBy(*keys, *x).agg(F.sum("y").alias("won"), F.count("*").alias("n"))


@query(None)
def yearly_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic fit of each year's games, all years in the same passes, and the years' order by the rated logit's slope."""
    fits = keyed_newton(_cells(forecasts(spark, sf_dir).withColumn("key", F.year("date")), "key"))
    order = Window.orderBy(F.desc("b1"), "key")  # a row a year
    return fits.select(F.col("key").alias("year"), "b0", "b1", "b2", "se0", "se1", "se2", F.row_number().over(order).alias("rank"))


def resampled(cells: DataFrame, reps: int) -> DataFrame:
    """keyed cells of `reps` resamples of whole matches, by Poisson weights that are hashes of (match, rep). cells: match_id, x0, x1, x2, won, n."""
    return resampled_sums(cells, "match_id", ["x0", "x1", "x2"], ["won", "n"], reps)


@query(None)
def resampled_fit(spark: SparkSession, sf_dir: str, reps: int = 2000) -> DataFrame:
    """The fit's spread over resamples of whole matches, all refitted in six passes: mean, standard deviation, and the middle 95 of 100."""
    fits = keyed_newton(resampled(_cells(forecasts(spark, sf_dir), "match_id"), reps))
    names = ("intercept", "rated", "mlp")
    long = fits.select("key", F.inline(F.array(*(F.struct(F.lit(n).alias("name"), F.col(f"b{i}").alias("b")) for i, n in enumerate(names)))))
    placed = long.withColumn("i", F.row_number().over(Window.partitionBy("name").orderBy("b", "key")))  # a row a resample
    end = lambda k: F.max(F.when(F.col("i") == k, F.col("b")))
    cut = reps // 40
    return placed.groupBy("name").agg(F.count("*").alias("reps"), F.avg("b").alias("mean"), F.stddev_samp("b").alias("sd"), end(cut + 1).alias("lo"), end(reps - cut).alias("hi"))


def race_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games as cells of what their forecast depends on: the sides' difference in sums and in gaps of ratings, and the target."""
    v = [rating(F.col(c)) for c in ("a1", "a2", "b1", "b2")]
    total, gap = F.round(v[0] + v[1] - v[2] - v[3], 2), F.round(F.abs(v[0] - v[1]) - F.abs(v[2] - v[3]), 2)
    g = games(spark, sf_dir).where("not is_forfeit")
    return g.groupBy(total.alias("total"), gap.alias("gap"), "target").agg(F.sum((F.col("margin") > 0).cast("double")).alias("won"), F.count("*").cast("double").alias("n"))


def race_loss(x: list[float]):
    """A cell's share of the negative log-likelihood at (scale, gamma)."""
    p = race_win(sigmoid(x[0] * F.col("total") + x[1] * F.col("gap")), F.col("target"))
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    return -(F.col("won") * F.ln(p) + (F.col("n") - F.col("won")) * F.ln(1 - p))


@query(None)
def race_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scale of summed ratings and the weight of a pair's gap that forecast games best through the race."""
    cells = written(race_cells(spark, sf_dir).repartition(16), "cells")  # few rows, each with much to reckon
    (scale, gamma), loss, _ = simplex.nelder_mead(cells, race_loss, [0.1, 0.0])
    n = cells.agg(F.sum("n")).first()[0]
    return spark.createDataFrame([(scale, gamma, loss / n if n else None)], "scale double, gamma double, nll double")
