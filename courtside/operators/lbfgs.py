"""Many minima at once by limited-memory BFGS, with every vector in a table.

Each fit's point, gradient and past steps are columns of a row a name; only the products of these vectors (a few numbers a fit) come to the driver, where the
two-loop recursion turns them into the coefficients of the next direction. Nothing on the driver grows with the names or the data. All fits that aren't done
share each pass: one evaluation of loss and gradient, one aggregate of products.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.sources.storage import discard, written

MEMORY = 10
#: How much of the slope a step has to bring, and how a step that doesn't is shortened.
ENOUGH, SHORTER = 1e-4, 0.4
#: Share of the loss that a pass has to gain.
TOO_LITTLE = 1e-11


@dataclass
class _Fit:
    loss: float = np.inf
    coef: list[float] = field(default_factory=list)  # of past steps, past changes of the gradient, and the gradient
    step: float = 0.0
    slope: float = 0.0
    taken: bool = True  # whether the trial becomes the point
    kept: bool = False  # whether its step is remembered
    pairs: int = 0
    done: bool = False
    passes: int = 0
    products: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # of past steps and changes with each other


def _direction(products: np.ndarray, pairs: int) -> np.ndarray:
    """Coefficients of the direction; products: of pairs steps, pairs changes and the gradient with each other."""
    coef = np.zeros(2 * pairs + 1)
    coef[-1] = -1
    alpha = np.zeros(pairs)
    for i in reversed(range(pairs)):
        alpha[i] = coef @ products[:, i] / products[i, pairs + i]
        coef[pairs + i] -= alpha[i]
    if pairs:
        coef *= products[pairs - 1, 2 * pairs - 1] / products[2 * pairs - 1, 2 * pairs - 1]
    for i in range(pairs):
        beta = coef @ products[:, pairs + i] / products[i, pairs + i]
        coef[i] += alpha[i] - beta
    return coef


def minimized(start: DataFrame, loss: Callable[[DataFrame], DataFrame], passes: int = 50, until: float = 1e-4) -> tuple[DataFrame, dict[str, tuple[float, int]]]:
    """(fit, name, x) where each fit's loss is least, and each fit's loss and passes.

    start: fit, name, x, scale (about the size of a step in it), ridge (half of it times x squared is added to the loss). loss gets (fit, name, x) and
    gives (fit, name, f, g): g is the gradient, and the f of a fit's names sum up to its loss. A fit is done when its gradient, in units of scale, is under `until` times
    the point's or 1, or when no step helps any more.
    """
    spark = start.sparkSession
    tables: list[str] = []
    empty = F.expr("cast(array() as array<double>)")
    state = written(start.select("fit", "name", "scale", "ridge", (F.col("x") / F.col("scale")).alias("z"), F.lit(0.0).alias("g"), empty.alias("s"), empty.alias("y")), "lbfgs", tables)
    ended: list[DataFrame] = []
    fits = {r.fit: _Fit() for r in state.select("fit").distinct().collect()}
    for _ in range(passes):
        going = [k for k, f in fits.items() if not f.done]
        if not going:
            break
        plan = spark.createDataFrame([(k, f.coef or [0.0], f.step) for k, f in fits.items() if not f.done], "fit string, coef array<double>, step double").coalesce(1)
        moved = state.join(F.broadcast(plan), "fit")  # a row a fit
        base = F.concat("s", "y", F.array("g"))
        moved = moved.withColumn("d", F.aggregate(F.zip_with(base, "coef", lambda b, c: F.coalesce(b * c, F.lit(0.0))), F.lit(0.0), lambda a, b: a + b)).withColumn("trial", F.col("z") + F.col("step") * F.col("d"))
        at = loss(moved.select("fit", "name", (F.col("trial") * F.col("scale")).alias("x")))
        x = F.col("trial") * F.col("scale")
        seen = moved.join(at.select("fit", "name", "f", F.col("g").alias("raw")), ["fit", "name"], "left")
        seen = seen.withColumns({"f": F.coalesce("f", F.lit(0.0)) + F.col("ridge") * x * x / 2, "g_trial": (F.coalesce("raw", F.lit(0.0)) + F.col("ridge") * x) * F.col("scale")})
        now: list[str] = []
        seen = written(seen.select("fit", "name", "scale", "ridge", "z", "g", "s", "y", "trial", "f", "g_trial"), "lbfgs", now)
        discard(spark, tables)
        tables = now
        step_made, change = F.col("trial") - F.col("z"), F.col("g_trial") - F.col("g")
        most = max(fits[k].pairs for k in going)
        past = [*(("s", F.get("s", F.lit(i)), i) for i in range(most)), *(("y", F.get("y", F.lit(i)), i) for i in range(most))]
        fresh = {"s": step_made, "y": change, "g": F.col("g_trial")}
        sums = {f"{name}_{kind}{i}": F.sum(v * old) for name, v in fresh.items() for kind, old, i in past}
        sums |= {f"{one}_{two}": F.sum(fresh[one] * fresh[two]) for one, two in ("ss", "sy", "yy", "gs", "gy", "gg")}
        got = seen.groupBy("fit").agg(F.sum("f").alias("f"), F.sum(F.col("trial") * F.col("trial")).alias("zz"), *(c.alias(k) for k, c in sums.items())).collect()
        for r in got:
            fit = fits[r.fit]
            fit.passes += 1
            first = not fit.coef
            fit.taken, fit.kept = first or bool(np.isfinite(r.f) and r.f <= fit.loss + ENOUGH * fit.step * fit.slope), False
            if not fit.taken:
                fit.step *= SHORTER
                fit.done = fit.step < 1e-8
                continue
            n = fit.pairs
            order = [("s", i) for i in range(n)] + [("s", None)] + [("y", i) for i in range(n)] + [("y", None), ("g", None)]
            products = np.zeros((2 * n + 3, 2 * n + 3))
            old = [i for i, (_, k) in enumerate(order) if k is not None]
            products[np.ix_(old, old)] = fit.products
            for i, (one, k) in enumerate(order):
                for j, (two, m) in enumerate(order[: i + 1]):
                    if k is None and m is None:
                        value = r[f"{one}_{two}"] if f"{one}_{two}" in sums else r[f"{two}_{one}"]
                    elif k is None:
                        value = r[f"{one}_{two}{m}"]
                    elif m is None:
                        value = r[f"{two}_{one}{k}"]
                    else:
                        continue
                    products[i, j] = products[j, i] = value or 0.0
            s, y = n, 2 * n + 1
            fit.kept = not first and bool(products[s, y] > 1e-10 * products[y, y])
            drop = {s, y} if not fit.kept else {0, n + 1} if n == MEMORY else set()
            own = [i for i in range(2 * n + 3) if i not in drop]
            products = products[np.ix_(own, own)]
            fit.pairs, fit.products = (len(own) - 1) // 2, products[:-1, :-1]
            gain, fit.loss = fit.loss - r.f, r.f
            norm = np.sqrt(products[-1, -1])
            fit.coef = _direction(products, fit.pairs).tolist()
            fit.slope = float(np.array(fit.coef) @ products[:, -1])
            fit.step = 1.0 if fit.pairs else float(min(1.0, 1 / max(norm, 1e-300)))
            fit.done = bool(norm <= until * max(1.0, np.sqrt(r.zz)) or (not first and gain <= TOO_LITTLE * abs(r.f)) or fit.slope >= 0)
        flags = spark.createDataFrame([(k, fits[k].taken, fits[k].kept) for k in going], "fit string, taken boolean, kept boolean").coalesce(1)
        longer = lambda old, new: F.when(F.col("kept"), F.slice(F.concat(old, F.array(new)), F.greatest(F.size(old) + 2 - MEMORY, F.lit(1)), MEMORY)).otherwise(F.col(old))
        on = seen.join(F.broadcast(flags), "fit")
        after = on.select("fit", "name", "scale", "ridge", F.when(F.col("taken"), F.col("trial")).otherwise(F.col("z")).alias("z"), F.when(F.col("taken"), F.col("g_trial")).otherwise(F.col("g")).alias("g"), longer("s", F.col("trial") - F.col("z")).alias("s"), longer("y", F.col("g_trial") - F.col("g")).alias("y"))
        state = after  # read from `seen` by the next pass
        if any(fits[k].done for k in going):
            ended.append(written(after.join(F.broadcast(flags.where(F.col("fit").isin([k for k in going if fits[k].done]))), "fit", "left_semi"), "lbfgs-done"))
            state = after.where(~F.col("fit").isin([k for k in going if fits[k].done]))
    out = written(state, "lbfgs-done")
    discard(spark, tables)
    for part in ended:
        out = out.unionByName(part)
    return out.select("fit", "name", (F.col("z") * F.col("scale")).alias("x")), {k: (f.loss, f.passes) for k, f in fits.items()}


def minimized_few(start: dict[str, tuple], loss: Callable[[dict[str, np.ndarray]], dict[str, tuple[float, np.ndarray]]], passes: int = 50, until: float = 1e-4) -> tuple[dict[str, np.ndarray], dict[str, tuple[float, int]]]:
    """minimized() for vectors that are known to be few numbers: they are held here, so a pass is one evaluation and nothing else.

    start: x, scale and ridge by fit. loss gets x by fit (of those that aren't done) and gives loss and gradient. Gives x by fit, and each fit's loss and passes.
    """
    fits = {k: _Fit() for k in start}
    scale, ridge = {k: v[1] for k, v in start.items()}, {k: v[2] for k, v in start.items()}
    z = {k: v[0] / v[1] for k, v in start.items()}
    g = {k: np.zeros(len(v)) for k, v in z.items()}
    past: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {k: [] for k in start}
    base = lambda k: np.array([*(s for s, _ in past[k]), *(y for _, y in past[k]), g[k]])
    for _ in range(passes):
        going = [k for k, f in fits.items() if not f.done]
        if not going:
            break
        trial = {k: z[k] + fits[k].step * (np.array(fits[k].coef) @ base(k)) if fits[k].coef else z[k] for k in going}
        got = loss({k: t * scale[k] for k, t in trial.items()})
        for k in going:
            fit, x = fits[k], trial[k] * scale[k]
            value, slope = got.get(k, (0.0, np.zeros(len(x))))
            value, slope = value + float((ridge[k] * x * x).sum()) / 2, (slope + ridge[k] * x) * scale[k]
            fit.passes += 1
            first = not fit.coef
            if not (first or (np.isfinite(value) and value <= fit.loss + ENOUGH * fit.step * fit.slope)):
                fit.step *= SHORTER
                fit.done = fit.step < 1e-8
                continue
            s, y = trial[k] - z[k], slope - g[k]
            if not first and s @ y > 1e-10 * (y @ y):
                past[k] = [*past[k], (s, y)][-MEMORY:]
            z[k], g[k] = trial[k], slope
            gain, fit.loss, fit.pairs = fit.loss - value, value, len(past[k])
            products = base(k) @ base(k).T
            norm = np.sqrt(products[-1, -1])
            coef = _direction(products, fit.pairs)
            fit.coef, fit.slope = coef.tolist(), float(coef @ products[:, -1])
            fit.step = 1.0 if fit.pairs else float(min(1.0, 1 / max(norm, 1e-300)))
            fit.done = bool(norm <= until * max(1.0, np.sqrt(z[k] @ z[k])) or (not first and gain <= TOO_LITTLE * abs(value)) or fit.slope >= 0)
    return {k: z[k] * scale[k] for k in start}, {k: (f.loss, f.passes) for k, f in fits.items()}
