"""Traits and whether they are more than chance: servers in rallies that matter, players against strong opponents."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from courtside.operators.ranks import ranked_within
from courtside.operators.serve import leverage
from courtside.sources.storage import written


def leveraged(rallies: DataFrame, states: DataFrame, group: list[str], flat: float = 1e-9) -> DataFrame:
    """rallies (server, match_id, eta, a, b, s, won and the columns of group) with lz, a rally's leverage in deviations within its group, and res, won less the chance to.

    states: serve_table of all eta in use, which is broadcast: its size goes with distinct eta, not with rallies. Rallies in a state it hasn't are left out, and
    groups whose rallies all matter alike (deviation below `flat`).
    """
    swing = leverage(states)
    chance = states.select("eta", "ka", "kb").distinct()
    own = Window.partitionBy(*group)
    at = rallies.join(F.broadcast(swing), ["eta", "a", "b", "s"]).join(F.broadcast(chance), "eta")
    at = at.withColumns({"_m": F.avg("swing").over(own), "_d": F.stddev_pop("swing").over(own)}).where(F.col("_d") >= flat)
    expected = F.when(F.col("s").startswith("A"), F.col("ka")).otherwise(F.col("kb"))
    return at.select("server", "match_id", *(g for g in group if g != "match_id"), ((F.col("swing") - F.col("_m")) / F.col("_d")).alias("lz"), (F.col("won") - expected).alias("res"))


def clutch_scores(rows: DataFrame, least: int = 300) -> DataFrame:
    """server, n, clutch (mean of lz * res), null_sd, z, half1 and half2 (every other match, by id, of that server; null where there is none), for servers with `least` rallies.

    null_sd is the deviation of the score when a server's results are dealt anew among its rallies, in closed form over all n! deals: the root of
    (sum of squares of lz about its mean) * (the same of res) / (n - 1), over n. So no deal is drawn, and rows are summed by server and match before they are moved again.
    """
    sums = {"n": F.count("*"), "x": F.sum("lz"), "y": F.sum("res"), "xx": F.sum(F.col("lz") * F.col("lz")), "yy": F.sum(F.col("res") * F.col("res")), "xy": F.sum(F.col("lz") * F.col("res"))}
    by_match = rows.groupBy("server", "match_id").agg(*(v.alias(k) for k, v in sums.items()))
    by_match = ranked_within(by_match, ["server"], ["match_id"], "_i")
    half = lambda k: (F.sum(F.when(F.col("_i") % 2 == k, F.col("xy"))) / F.sum(F.when(F.col("_i") % 2 == k, F.col("n"))))
    s = by_match.groupBy("server").agg(*(F.sum(c).alias(c) for c in sums), half(1).alias("half1"), half(0).alias("half2")).where(F.col("n") >= least)
    about = lambda q, m: F.greatest(F.col(q) - F.col(m) * F.col(m) / F.col("n"), F.lit(0.0))
    sd = F.when(F.col("n") > 1, F.sqrt(about("xx", "x") * about("yy", "y") / (F.col("n") - 1)) / F.col("n")).otherwise(0.0)
    s = s.withColumns({"clutch": F.col("xy") / F.col("n"), "null_sd": sd})
    return s.select("server", "n", "clutch", "null_sd", F.when(F.col("null_sd") > 0, F.col("clutch") / F.col("null_sd")).otherwise(0.0).alias("z"), "half1", "half2")


def trait_summary(scores: DataFrame, score: str, least: int = 11) -> DataFrame:
    """One row for scores (score, null_sd, z, half1, half2 and their player's `value`): players, mean and variance of z (more than 1 is more than chance), likeness
    of halves, likeness to value and trend by it, and the variance of z and the likeness of halves when the line on value is taken out; from the third on for `least` players and more.
    """
    line = scores.agg(
        F.count("*").alias("players"), F.avg("z").alias("z_mean"), F.var_pop("z").alias("z_var"), F.regr_count("half1", "half2").alias("_h"), F.corr("half1", "half2").alias("_r"),
        F.corr("value", score).alias("_v"), F.regr_slope(score, "value").alias("_b"), F.regr_intercept(score, "value").alias("_a"))
    fitted = F.col("_a") + F.col("_b") * F.col("value")
    left = F.when(F.col("null_sd") > 0, (F.col(score) - fitted) / F.col("null_sd"))
    rest = scores.join(F.broadcast(line.select("_a", "_b")), how="cross").agg(F.var_pop(left).alias("_z"), F.corr(F.col("half1") - fitted, F.col("half2") - fitted).alias("_hr"))  # one row beside each
    enough = lambda c, n="players": F.when(F.col(n) >= least, F.col(c))
    return line.join(rest, how="cross").select("players", "z_mean", "z_var", enough("_r", "_h").alias("half_r"), enough("_v").alias("value_r"), enough("_b").alias("trend"), enough("_z").alias("z_var_rest"), enough("_hr", "_h").alias("half_r_rest"))


#: Sums of a player's rows: how many, opponents' strength, results, their squares and their product.
SUMS = {"n": "1D", "o": "opp", "y": "y", "oo": "opp * opp", "yy": "y * y", "oy": "opp * y"}


def summed(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*(F.sum(F.expr(e)).alias(k) for k, e in SUMS.items()))


def month_halves(months: DataFrame) -> DataFrame:
    """months (summed by player and month) with half: 1 or 2 where a month lies wholly in the earlier or the later half of its player's rows, null where the halves meet in it, and take: how many of its rows are of the earlier one."""
    own = Window.partitionBy("player")  # a row a month
    before = F.sum("n").over(own.orderBy("month")) - F.col("n")
    d = months.withColumn("take", F.floor(F.sum("n").over(own) / 2) - before)
    return d.withColumn("half", F.when(F.col("take") >= F.col("n"), 1).when(F.col("take") <= 0, 2))


def standard_halves(parts: DataFrame) -> DataFrame:
    """slopes()' sums of parts (player, half, and SUMS): x is the opponents' strength in deviations from the mean of all rows."""
    by = written(parts.groupBy("player", "half").agg(*(F.sum(k).alias(k) for k in SUMS)), "halves")
    mean = F.sum("o") / F.sum("n")
    line = by.agg(mean.alias("mu"), F.sqrt(F.sum("oo") / F.sum("n") - mean * mean).alias("sd"))
    at = by.join(F.broadcast(line), how="cross")  # one row beside each
    x = {"n": "n", "x": "(o - n * mu) / sd", "y": "y", "xx": "(oo - 2 * mu * o + n * mu * mu) / (sd * sd)", "yy": "yy", "xy": "(oy - mu * y) / sd"}
    return at.groupBy("player").agg(*(F.coalesce(F.sum(F.when(F.col("half") == h, F.expr(e))), F.lit(0.0)).alias(f"{k}{h}") for h in (1, 2) for k, e in x.items()))


def durability_scores(rows: DataFrame, least: int = 100, flat: float = 1e-6) -> DataFrame:
    """player, n, slope of y on x, null_sd, z, half1 and half2 (slopes of the earlier and the later half, the odd row to the later), for players with `least` rows whose x vary.

    rows: player, x, y, and half (1 or 2). null_sd is the slope's deviation when the y of a player are dealt anew, in closed form over all deals: the root of
    (squares of y about its mean) / (those of x) / (n - 1). So nothing is drawn and rows are summed before the shuffle. Slopes of halves whose x don't vary are null.
    """
    one = lambda v, h: F.when(F.col("half") == h, v)
    x, y = F.col("x"), F.col("y")
    terms = {"n": F.lit(1.0), "x": x, "y": y, "xx": x * x, "yy": y * y, "xy": x * y}
    sums = {f"{k}{h}": F.sum(one(e, h)) for h in (1, 2) for k, e in terms.items()}
    return slopes(rows.groupBy("player").agg(*(F.coalesce(v, F.lit(0.0)).alias(k) for k, v in sums.items())), least, flat)


def slopes(s: DataFrame, least: int, flat: float = 1e-6) -> DataFrame:
    """durability_scores() of sums by player: n, x, y, xx, yy and xy of each half (n1, n2, ...)."""
    whole = lambda k: F.col(f"{k}1") + F.col(f"{k}2")
    part = lambda h: (lambda k: F.col(f"{k}{h}"))
    about = lambda of, a, b: of(a + b) - of(a) * of(b) / of("n")
    slope = lambda of: F.when((of("n") > 0) & (about(of, "x", "x") > 1e-9), about(of, "x", "y") / about(of, "x", "x"))
    s = s.where((whole("n") >= least) & (about(whole, "x", "x") / whole("n") >= flat * flat))
    s = s.select("player", whole("n").cast("long").alias("n"), slope(whole).alias("slope"), F.sqrt(F.greatest(about(whole, "y", "y"), F.lit(0.0)) / about(whole, "x", "x") / (whole("n") - 1)).alias("null_sd"), slope(part(1)).alias("half1"), slope(part(2)).alias("half2"))
    return s.select("player", "n", "slope", "null_sd", F.when(F.col("null_sd") > 0, F.col("slope") / F.col("null_sd")).otherwise(0.0).alias("z"), "half1", "half2")
