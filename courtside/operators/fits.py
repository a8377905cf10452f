"""Iterative fits: each step's sums are one aggregate, and only sums (or the small table of values) go on."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.functions.probability import sigmoid
from courtside.sources.storage import discard, written


def logistic_newton(rows: DataFrame, names: list[str], steps: int = 6) -> DataFrame:
    """rows: y, x (array). One row for each name: estimate and standard error."""
    rows, k = written(rows), len(names)
    beta = np.zeros(k)
    x = lambda i: F.col("x")[i]
    for _ in range(steps):
        p = sigmoid(sum((F.lit(float(b)) * x(i) for i, b in enumerate(beta)), F.lit(0.0)))
        sums = [F.sum((F.col("y") - p) * x(i)) for i in range(k)] + [F.sum(p * (1 - p) * x(i) * x(j)) for i in range(k) for j in range(k)]
        got = np.array([v or 0.0 for v in rows.agg(*(s.alias(f"s{n}") for n, s in enumerate(sums))).first()])
        hess = got[k:].reshape(k, k) + 1e-9 * np.eye(k)
        beta = beta + np.linalg.solve(hess, got[:k])
    error = np.sqrt(np.diag(np.linalg.inv(hess)))
    return rows.sparkSession.createDataFrame([(n, float(b), float(e)) for n, b, e in zip(names, beta, error)], "name string, estimate double, se double")


def paired_map(met: DataFrame, steps: int = 200, prior_sd: float = 0.5, until: float = 1e-9) -> DataFrame:
    """met: a, b, won (by a), n. (player, value): most likely values under a normal prior, by scaled gradient steps; fewer than `steps` if none moves by more than `until`.

    Values are a table joined to the meetings, so nothing depends on how many players there are. Each step reads
    the values twice, so its result is written before the next: plans would double with each step otherwise.
    """
    met = written(met)
    both = written(met.select("a", "b", "won", "n").unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), (F.col("n") - F.col("won")).alias("won"), "n")))
    values = written(both.select(F.col("a").alias("player")).distinct().withColumn("value", F.lit(0.0)))
    old: list[str] = []
    for step in range(steps):
        own, other = values.select(F.col("player").alias("a"), F.col("value").alias("va")), values.select(F.col("player").alias("b"), F.col("value").alias("vb"))
        p = sigmoid(F.col("va") - F.col("vb"))
        g = both.join(own, "a").join(other, "b").groupBy("a", "va").agg(F.sum(F.col("won") - F.col("n") * p).alias("g"), F.sum(F.col("n") * p * (1 - p)).alias("h"))
        prior = 1 / prior_sd**2
        now: list[str] = []
        values = written(g.select(F.col("a").alias("player"), (F.col("va") + 0.7 * (F.col("g") - prior * F.col("va")) / (F.col("h") + prior)).alias("value"), F.col("va").alias("was")), "values", now)
        discard(met.sparkSession, old)
        old = now
        if step % 5 == 4 and (values.agg(F.max(F.abs(F.col("value") - F.col("was")))).first()[0] or 0) <= until:
            break
        values = values.drop("was")
    return values.select("player", "value")


def served_map(rallies: DataFrame, steps: int = 60, prior_sd: float = 0.25, until: float = 1e-6) -> DataFrame:
    """rallies: server, receiver, won (by the server's side), n. (player, serve, back): most likely values of serving and of returning under a normal prior,
    beside one intercept for all (player null, in `serve`). A rally's logit is intercept + serve of one - back of the other."""
    met = written(rallies.select("server", "receiver", "won", "n"))
    players = met.select(F.col("server").alias("player")).union(met.select("receiver")).distinct()
    start: list[str] = []
    values = written(players.select("player", F.lit(0.0).alias("serve"), F.lit(0.0).alias("back")), "values", start)
    total = met.agg(F.sum("won").alias("w"), F.sum("n").alias("n")).first()
    share = (float(total.w or 0) + 0.5) / (float(total.n or 0) + 1)
    alpha, prior, old = float(np.log(share / (1 - share))), 1 / prior_sd**2, start
    for step in range(steps):
        by, to = values.select(F.col("player").alias("server"), "serve"), values.select(F.col("player").alias("receiver"), "back")
        p = sigmoid(F.lit(alpha) + F.col("serve") - F.col("back"))
        rows = met.join(by, "server").join(to, "receiver").select("server", "receiver", (F.col("won") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"))
        sides = rows.select(F.inline(F.array(F.struct(F.col("server").alias("player"), F.col("g").alias("gs"), F.col("h").alias("hs"), F.lit(0.0).alias("gr"), F.lit(0.0).alias("hr")), F.struct(F.col("receiver").alias("player"), F.lit(0.0).alias("gs"), F.lit(0.0).alias("hs"), (-F.col("g")).alias("gr"), F.col("h").alias("hr")))))
        sums = sides.groupBy("player").agg(*(F.sum(c).alias(c) for c in ("gs", "hs", "gr", "hr")))
        moved = lambda v, g, h: F.col(v) + 0.5 * (F.col(g) - prior * F.col(v)) / (F.col(h) + prior)
        now: list[str] = []
        values = written(values.select("player", "serve", "back").join(sums, "player").select("player", moved("serve", "gs", "hs").alias("serve"), moved("back", "gr", "hr").alias("back"), "gs", "hs", F.greatest(F.abs(moved("serve", "gs", "hs") - F.col("serve")), F.abs(moved("back", "gr", "hr") - F.col("back"))).alias("step")), "values", now)
        discard(met.sparkSession, old)
        old = now
        s = values.agg(F.sum("gs").alias("g"), F.sum("hs").alias("h"), F.max("step").alias("step")).first()
        change = 0.5 * (s.g or 0.0) / ((s.h or 0.0) + 1e-9)
        alpha += change
        if max(abs(change), s.step or 0) <= until:
            break
    head = met.sparkSession.createDataFrame([(None, alpha, None)], values.select("player", "serve", "back").schema)
    return values.select("player", "serve", "back").unionByName(head)


def _solved(h: dict[tuple[int, int], F.Column], g: list[F.Column]) -> tuple[list[F.Column], list[F.Column]]:
    """(h^-1 g, diagonal of h^-1) of a symmetric 3 x 3 matrix by its cofactors."""
    a, b, c, d, e, f = h[0, 0], h[0, 1], h[0, 2], h[1, 1], h[1, 2], h[2, 2]
    co = [[d * f - e * e, c * e - b * f, b * e - c * d], [None, a * f - c * c, b * c - a * e], [None, None, a * d - b * b]]
    at = lambda i, j: co[min(i, j)][max(i, j)]
    det = a * at(0, 0) + b * at(0, 1) + c * at(0, 2)
    return [sum((at(i, j) * g[j] for j in range(3)), F.lit(0.0)) / det for i in range(3)], [at(i, i) / det for i in range(3)]


def keyed_newton(cells: DataFrame, steps: int = 6, ridge: float = 1e-9) -> DataFrame:
    """Logistic fits of three parameters for every key at once: key, b0, b1, b2, se0, se1, se2.

    cells: key, x0, x1, x2, won, n (weights may have any size, n > 0). A step is one sum by key over all cells, and the 3 x 3 system of each key is solved in its row;
    the rows of a key are summed in parts before they meet. A key with too little to tell its parameters apart is held by the ridge.
    """
    spark, own = cells.sparkSession, []
    cells = written(cells.select("key", "x0", "x1", "x2", F.col("won").cast("double").alias("won"), F.col("n").cast("double").alias("n")), "cells", own)
    beta = cells.select("key").distinct().select("key", *(F.lit(0.0).alias(f"b{i}") for i in range(3)))
    tables: list[str] = []
    for _ in range(steps):
        x = [F.col(f"x{i}") for i in range(3)]
        p = sigmoid(sum((F.col(f"b{i}") * x[i] for i in range(3)), F.lit(0.0)))
        at = cells.join(beta, "key").withColumns({"miss": F.col("won") - F.col("n") * p, "w": F.col("n") * p * (1 - p)})
        pairs = [(i, j) for i in range(3) for j in range(i, 3)]
        sums = at.groupBy("key", "b0", "b1", "b2").agg(*(F.sum(F.col("miss") * x[i]).alias(f"g{i}") for i in range(3)), *(F.sum(F.col("w") * x[i] * x[j]).alias(f"h{i}{j}") for i, j in pairs))
        move, spread = _solved({(i, j): F.col(f"h{i}{j}") + (ridge if i == j else 0.0) for i, j in pairs}, [F.col(f"g{i}") for i in range(3)])
        now: list[str] = []
        beta = written(sums.select("key", *((F.col(f"b{i}") + move[i]).alias(f"b{i}") for i in range(3)), *(F.sqrt(spread[i]).alias(f"se{i}") for i in range(3))), "newton", now)
        discard(spark, tables)
        tables = now
        last, beta = beta, beta.select("key", "b0", "b1", "b2")
    discard(spark, own)
    return last
