"""Least squares with many fixed effects, by conjugate gradients over tables.

A row of the design has a few entries of +1 and -1 (its players, its tour), so a product with the normal matrix is a join of the rows with a value for
each effect and a sum by effect; no matrix is built anywhere. Rows with the same effects are one cell. Several right sides are solved in the same
passes. Effects that the rows can't tell apart (all players plus a constant) leave the normal matrix without full rank: its right sides lie
in its range, where conjugate gradients stay, so what is fitted is right although the effects are not unique.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtside.sources.storage import discard, written

#: Columns of a row that name its effects, with their signs.
Slots = dict[str, int]


def _summed(rows: DataFrame, slots: Slots, value: Column, size: int) -> DataFrame:
    """node and the sums of value (an array of `size`) times the entries' signs."""
    signed = {1: value, -1: F.transform(value, lambda v: -v)}
    parts = rows.select(F.inline(F.array(*(F.struct(F.col(c).alias("node"), signed[s].alias("v")) for c, s in slots.items()))))
    return parts.groupBy("node").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(size))).alias("v"))


def _fitted(rows: DataFrame, slots: Slots, values: DataFrame, size: int) -> DataFrame:
    """rows with `fit`: the sum of the signed values (node, x: array of `size`) of their effects."""
    for c in slots:
        rows = rows.join(values.select(F.col("node").alias(c), F.col("x").alias(f"_{c}")), c)
    fit = F.array(*(sum((s * F.col(f"_{c}")[i] for c, s in slots.items()), F.lit(0.0)) for i in range(size)))
    return rows.withColumn("fit", fit).drop(*(f"_{c}" for c in slots))


def effects(rows: DataFrame, slots: Slots, columns: list[str], steps: int = 200, until: float = 1e-9) -> tuple[DataFrame, int]:
    """(node, x: an array of an effect for each of columns, the last one left to the minimum), and the passes. Nodes of different slots have different names or are the same effect."""
    spark, k, scratch = rows.sparkSession, len(columns), []
    cells = rows.groupBy(*slots).agg(F.count("*").cast("double").alias("n"), F.array(*(F.sum(F.col(c).cast("double")) for c in columns)).alias("v"))
    cells = written(cells, "cells", scratch)
    right = _summed(cells, slots, F.col("v"), k)
    weight = cells.select("n", F.explode(F.array(*slots)).alias("node")).groupBy("node").agg(F.sum("n").alias("d"))
    zero = F.array(*[F.lit(0.0)] * k)
    state = right.join(weight, "node").select("node", "d", zero.alias("x"), F.col("v").alias("r"), F.transform("v", lambda v: v / F.col("d")).alias("p"))
    tables: list[str] = []
    state = written(state, "effects", tables)
    first = state.agg(*(F.sum(F.pow(F.col("r")[i], 2) / F.col("d")).alias(f"z{i}") for i in range(k))).first()
    rz = np.array([first[i] or 0.0 for i in range(k)])
    start, done, going = rz.copy(), 0, np.ones(k, bool)
    for done in range(1, steps + 1):
        going &= rz > until**2 * np.maximum(start, 1e-300)
        if not going.any():
            done -= 1
            break
        at = _fitted(cells.select(*slots, "n"), slots, state.select("node", F.col("p").alias("x")), k)
        q = _summed(at, slots, F.transform("fit", lambda f: f * F.col("n")), k)
        now: list[str] = []
        seen = written(state.join(q.withColumnRenamed("v", "q"), "node"), "effects", now)
        sums = {}
        for i in range(k):
            p, qi = F.col("p")[i], F.col("q")[i]
            sums[f"pq{i}"] = F.sum(p * qi)
        got = seen.agg(*(v.alias(c) for c, v in sums.items())).first()
        alpha = [float(rz[i] / got[f"pq{i}"]) if going[i] and got[f"pq{i}"] else 0.0 for i in range(k)]
        left = seen.agg(*(F.sum(F.pow(F.col("r")[i] - alpha[i] * F.col("q")[i], 2) / F.col("d")) for i in range(k))).first()  # the residual itself: a difference of sums would lose its digits
        new = np.array([left[i] or 0.0 for i in range(k)])
        beta = [float(new[i] / rz[i]) if going[i] and rz[i] else 0.0 for i in range(k)]
        rz = new
        step = spark.createDataFrame([(alpha, beta)], "alpha array<double>, beta array<double>").coalesce(1)  # one row
        on = seen.join(F.broadcast(step))
        of = lambda f: F.array(*(f(i) for i in range(k)))
        on = on.withColumns({"x": of(lambda i: F.col("x")[i] + F.col("alpha")[i] * F.col("p")[i]), "r": of(lambda i: F.col("r")[i] - F.col("alpha")[i] * F.col("q")[i])})
        state = on.select("node", "d", "x", "r", of(lambda i: F.col("r")[i] / F.col("d") + F.col("beta")[i] * F.col("p")[i]).alias("p"))
        discard(spark, tables)
        tables = now
    out = written(state.select("node", "x"), "effects")
    discard(spark, tables + scratch)
    return out, done


def within_regression(rows: DataFrame, slots: Slots, y: str, xs: tuple[str, str], cluster: str, steps: int = 200) -> DataFrame:
    """name, estimate, se of y on two regressors beside all effects of the slots; errors are robust to clusters (CR1: times G / (G - 1)).

    All three are freed of the effects first, then regressed on each other: sums of products are all that is needed.
    """
    columns = [y, *xs]
    values, _ = effects(rows, slots, columns, steps)
    free = _fitted(rows.select(*slots, cluster, *(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns))), slots, values, 3)
    free = written(free.select(cluster, *((F.col(f"v{i}") - F.col("fit")[i]).alias(c) for i, c in enumerate(("y", "a", "b")))), "free")
    s = free.agg(*(F.sum(F.expr(e)).alias(k) for k, e in {"aa": "a * a", "ab": "a * b", "bb": "b * b", "ay": "a * y", "by": "b * y"}.items())).first()
    gram = np.array([[s.aa or 0.0, s.ab or 0.0], [s.ab or 0.0, s.bb or 0.0]])
    inverse = np.linalg.pinv(gram, rcond=1e-10)
    beta = inverse @ np.array([s.ay or 0.0, s.by or 0.0])
    e = F.col("y") - float(beta[0]) * F.col("a") - float(beta[1]) * F.col("b")
    scores = free.groupBy(cluster).agg(F.sum(F.col("a") * e).alias("a"), F.sum(F.col("b") * e).alias("b"))
    m = scores.agg(F.count("*").alias("g"), *(F.sum(F.expr(x)).alias(k) for k, x in {"aa": "a * a", "ab": "a * b", "bb": "b * b"}.items())).first()
    meat = np.array([[m.aa or 0.0, m.ab or 0.0], [m.ab or 0.0, m.bb or 0.0]]) * m.g / max(m.g - 1, 1)
    error = np.sqrt(np.diag(inverse @ meat @ inverse))
    return rows.sparkSession.createDataFrame([(n, float(b), float(s)) for n, b, s in zip(xs, beta, error)], "name string, estimate double, se double")
