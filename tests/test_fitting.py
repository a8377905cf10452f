"""Fits against minima found by plain numpy."""
from math import comb

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark import AccumulatorParam
from pyspark.sql import functions as F

from courtside.operators import effects, lbfgs, refits, simplex
from courtside.operators.fits import keyed_newton
from courtside.plans import fitting
from courtside.plans.models import _M, mixed
from courtside.sources.tables import games

from .conftest import SMALL


def _dense(rows, players, fit):
    """Loss and gradient of one fit over all its observations, from the definition."""
    at = {p: i for i, p in enumerate(players)}
    a, b, c, d = (np.array([at[r[k]] for r in rows]) for k in refits.SIDES)
    won, n, m, mm = (np.array([r[k] for r in rows]) for k in ("won", "n", "m", "mm"))
    size = len(players)

    def pair(v, i, j, gamma):
        x, y = v[i], v[j]
        if fit.structure in ("sum", "gamma"):
            g = gamma * np.sign(x - y)
            return x + y + gamma * np.abs(x - y), 1 + g, 1 - g
        sign = -1 if fit.structure == "min" else 1
        share = 1 / (1 + np.exp(-sign * (x - y) / refits.SOFT))
        return 2 * sign * refits.SOFT * np.logaddexp(sign * x / refits.SOFT, sign * y / refits.SOFT), 2 * share, 2 * (1 - share)

    def f(x):
        v, gamma, spread = x[:size], x[size] if fit.structure == "gamma" else 0.0, x[size + 1]
        (one, ga, gb), (two, gc, gd) = pair(v, a, b, gamma), pair(v, c, d, gamma)
        eta, g = one - two, np.zeros(size + 2)
        if fit.level == "margin":
            miss = mm - 2 * eta * m + n * eta**2
            loss, slope = (miss / 2 * np.exp(-2 * spread) + n * spread).sum(), -(m - n * eta) * np.exp(-2 * spread)
            g[size + 1] = (n - miss * np.exp(-2 * spread)).sum()
        else:
            loss, slope = (won * np.logaddexp(0, -eta) + (n - won) * np.logaddexp(0, eta)).sum(), n / (1 + np.exp(-eta)) - won
        for i, k in ((a, ga), (b, gb), (c, -gc), (d, -gd)):
            np.add.at(g, i, slope * k)
        if fit.structure == "gamma":
            g[size] = (slope * (np.abs(v[a] - v[b]) - np.abs(v[c] - v[d]))).sum() + gamma / refits.SD_GAMMA**2
            loss += (gamma / refits.SD_GAMMA) ** 2 / 2
        g[:size] += v / refits.SD_VALUE**2
        return loss + (v**2).sum() / 2 / refits.SD_VALUE**2, g

    x = np.zeros(size + 2)
    x[size], x[size + 1] = (refits.GAMMA_FIRST if fit.structure == "gamma" else 0), (np.log(refits.SPREAD_FIRST) if fit.level == "margin" else 0)
    return f, x


def _descended(f, x, scale, steps=4000):
    """By scaled gradient steps with momentum, each as long as it helps."""
    loss, g = f(x)
    step, old = 0.5, np.zeros_like(x)
    for _ in range(steps):
        move = -step * scale**2 * g + 0.8 * old
        new, g_new = f(x + move)
        if new < loss:
            gain = loss - new
            x, loss, g, old, step = x + move, new, g_new, move, min(step * 1.1, 1.5)
            if gain < 1e-13 * loss:
                break
        else:
            step, old = step * 0.5, np.zeros_like(x)
            if step < 1e-12:
                break
    return x, loss


class _Most(AccumulatorParam):
    def zero(self, value):
        return 0

    def addInPlace(self, a, b):
        return max(a, b)


def test_refits_equal_dense_minima(spark):
    obs = refits.observations(games(spark, SMALL).where("not is_forfeit"))
    values, told = refits.refitted(obs)
    got = {}
    for r in values.collect():
        got.setdefault(r.fit, {})[r.name] = r.x
    assert max(passes for _, passes in told.values()) <= 50
    rows = {}
    for r in obs.collect():
        rows.setdefault(r.fit, []).append(r.asDict())
    for fit in refits.REFITS:
        players = sorted(p for p in got[fit.name] if p >= 0)
        f, start = _dense(rows[fit.name], players, fit)
        own = np.array([got[fit.name][p] for p in players] + [got[fit.name].get(refits.GAMMA, 0.0), got[fit.name].get(refits.LOG_SPREAD, 0.0)])
        loss, g = f(own)
        assert loss == pytest.approx(told[fit.name][0], rel=1e-9)
        n = np.zeros(len(own))
        for r in rows[fit.name]:
            for k in refits.SIDES:
                n[players.index(r[k])] += r["n"] / (16 if fit.level == "margin" else 4)
        scale = 1 / np.sqrt(n + 4)
        scale[-2:] = 0.01
        best, least = _descended(f, start, scale)
        assert loss <= least + 5e-6 * abs(least), fit
        if fit.structure == "sum":  # convex: what games show of the values is one minimum
            at = {p: i for i, p in enumerate(players)}
            eta = lambda x: np.array([x[at[r["a1"]]] + x[at[r["a2"]]] - x[at[r["b1"]]] - x[at[r["b2"]]] for r in rows[fit.name]])  # noqa: E731, B023
            assert np.abs(eta(own) - eta(best)).max() < 5e-3, fit


def test_refits_are_the_same_by_blocks_and_by_joins(spark, monkeypatch):
    """Few values are handed to blocks of observations, many are a table joined to the rows: the same steps, the same values."""
    obs = refits.observations(games(spark, SMALL).where("not is_forfeit and match_id % 10 = 0"))
    monkeypatch.setattr(refits, "BLOCK", 100)  # several blocks a fit and task
    blocks = refits.blocks_of(obs)
    seen = {}
    for r in blocks.select("fit", F.explode("names").alias("name")).distinct().collect():
        seen.setdefault(r.fit, {refits.GAMMA, refits.LOG_SPREAD}).add(r.name)
    names, rng = {k: np.array(sorted(v)) for k, v in seen.items()}, np.random.default_rng(5)
    x = {k: rng.normal(scale=0.3, size=len(v)) for k, v in names.items()}
    got = refits._block_loss(blocks, names)(x)
    at = spark.createDataFrame([(k, int(n), float(v)) for k in names for n, v in zip(names[k], x[k])], "fit string, name long, x double")
    want = {(r.fit, r.name): (r.f, r.g) for r in refits._loss(obs)(at).collect()}
    for fit in refits.REFITS:
        k = fit.name
        used = [i for i, n in enumerate(names[k]) if n >= 0 or (n == refits.GAMMA and fit.structure == "gamma") or (n == refits.LOG_SPREAD and fit.level == "margin")]
        assert got[k][0] == pytest.approx(sum(want[k, n][0] for n in names[k]), rel=1e-9)
        assert [got[k][1][i] for i in used] == pytest.approx([want[k, names[k][i]][1] for i in used], rel=1e-8, abs=1e-9)
    # the same steps from there, but for structures with a kink, where ties are told apart by the order of sums
    few = refits.refitted(obs, passes=3)[1]
    monkeypatch.setattr(refits, "FEW_VALUES", 0)
    many = refits.refitted(obs, passes=3)[1]
    for fit in refits.REFITS:
        if fit.structure != "gamma":
            assert few[fit.name] == (pytest.approx(many[fit.name][0], rel=1e-9), many[fit.name][1])


def test_blocks_are_read_and_handed_on_a_few_at_once(spark, monkeypatch):
    """Neither a reader nor a worker holds more than GROUP blocks, each of some 100 KB, however many observations a task has."""
    names = np.arange(400)
    block = refits._block(("margin", "gamma", "margin"), np.resize(names, (4, refits.BLOCK)), np.ones((4, refits.BLOCK)))
    assert len(block["at"]) + len(block["sums"]) <= 1 << 17
    monkeypatch.setattr(refits, "GROUP", 4)
    obs = refits.observations(games(spark, SMALL).where("not is_forfeit"))
    blocks = refits.blocks_of(obs)
    groups = [file.metadata.row_group(i).num_rows for file in map(pq.ParquetFile, (f.removeprefix("file://") for f in blocks.inputFiles())) for i in range(file.metadata.num_row_groups)]
    assert sum(groups) > 2 * refits.GROUP and max(groups) <= refits.GROUP
    known = {r.name: np.arange(-2, 400) for r in refits.REFITS}
    most, real = spark.sparkContext.accumulator(0, _Most()), refits._slopes

    def slopes(batches):
        def seen():
            for batch in batches:
                most.add(batch.num_rows)
                yield batch

        yield from real(seen())

    monkeypatch.setattr(refits, "_slopes", slopes)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = refits._block_loss(blocks, known)({k: np.zeros(len(v)) for k, v in known.items()})
    assert got["sum"][0] == pytest.approx(obs.where("fit = 'sum'").agg(F.sum("n")).first()[0] * np.log(2), rel=1e-9)
    assert 0 < most.value <= refits.GROUP and spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_holdout_refits_read_blocks_a_few_at_once(spark, monkeypatch):
    class Seen(Exception):
        pass

    def stop(blocks, names):
        raise Seen([file.metadata.row_group(i).num_rows for file in map(pq.ParquetFile, (f.removeprefix("file://") for f in blocks.inputFiles())) for i in range(file.metadata.num_row_groups)])

    monkeypatch.setattr(refits, "GROUP", 2)
    monkeypatch.setattr(refits, "_block_loss", stop)
    with pytest.raises(Seen) as seen:
        fitting.refit_holdout(spark, SMALL)
    groups = seen.value.args[0]
    assert sum(groups) >= len(refits.REFITS) and max(groups) <= 2


def test_observations_are_moved_once_for_all_fits(spark):
    plan = refits.observations(games(spark, SMALL))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate inline" in plan  # fits are told apart after the sums, not before


def test_races_of_known_targets(spark):
    from courtside.functions.probability import race_win, race_win_known

    rows = spark.createDataFrame([(p / 20, t) for p in range(21) for t in (11, 15, 21)], "p double, t int")
    for r in rows.select(race_win(F.col("p"), F.col("t")).alias("a"), race_win_known(F.col("p"), F.col("t")).alias("b")).collect():
        assert r.a == pytest.approx(r.b, rel=1e-10)


def test_rosenbrock_and_quadratics(spark):
    """Several fits at once, one of them curved, of different sizes."""
    names = [("bent", k, -1.2 if k == 0 else 1.0, 1.0, 0.0) for k in range(2)] + [("flat", k, 3.0, 1.0, 0.5) for k in range(5)]
    start = spark.createDataFrame(names, "fit string, name long, x double, scale double, ridge double")

    def loss(at):
        wide = at.where("fit = 'bent'").groupBy("fit").agg(F.max(F.when(F.col("name") == 0, F.col("x"))).alias("a"), F.max(F.when(F.col("name") == 1, F.col("x"))).alias("b"))
        bent = wide.select("fit", F.inline(F.array(F.struct(F.lit(0).cast("long").alias("name"), F.expr("pow(1 - a, 2) + 100 * pow(b - a * a, 2)").alias("f"), F.expr("-2 * (1 - a) - 400 * a * (b - a * a)").alias("g")), F.struct(F.lit(1).cast("long").alias("name"), F.lit(0.0).alias("f"), F.expr("200 * (b - a * a)").alias("g")))))
        return bent.unionByName(at.where("fit = 'flat'").select("fit", "name", F.expr("(name + 1) * pow(x - name, 2)").alias("f"), F.expr("2 * (name + 1) * (x - name)").alias("g")))

    got, told = lbfgs.minimized(start, loss, passes=80, until=1e-8)
    x = {(r.fit, r.name): r.x for r in got.collect()}
    assert x["bent", 0] == pytest.approx(1, abs=1e-4) and x["bent", 1] == pytest.approx(1, abs=1e-4)
    for k in range(5):
        assert x["flat", k] == pytest.approx(2 * (k + 1) * k / (2 * (k + 1) + 0.5), abs=1e-5)
    assert told["flat"][1] < told["bent"][1] <= 60


def test_two_way_effects_equal_dense_least_squares(spark):
    g = games(spark, SMALL).withColumn("tour_level", F.when(F.col("tour") == "MLP", -1).otherwise(-2).cast("long"))
    rows = g.select(*fitting.SLOTS, "margin", "target", "game_no", "match_id").collect()
    names = {n: i for i, n in enumerate(sorted({r[c] for r in rows for c in fitting.SLOTS}))}
    d = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        for c, s in fitting.SLOTS.items():
            d[i, names[r[c]]] += s
    y, x = np.array([r.margin for r in rows], float), np.array([[r.target, r.game_no] for r in rows], float)
    assert np.linalg.matrix_rank(d) < len(names)  # some effects can't be told apart
    free = lambda v: v - d @ np.linalg.lstsq(d, v, rcond=None)[0]
    x, y = free(x), free(y)
    inverse = np.linalg.inv(x.T @ x)
    beta = inverse @ x.T @ y
    e, own = y - x @ beta, {}
    for r, s in zip(rows, x * e[:, None]):
        own[r.match_id] = own.get(r.match_id, 0) + s
    meat = sum(np.outer(s, s) for s in own.values()) * len(own) / (len(own) - 1)
    want = np.sqrt(np.diag(inverse @ meat @ inverse))
    got = {r.name: (r.estimate, r.se) for r in fitting.two_way_effects(spark, SMALL).collect()}
    for i, n in enumerate(("target", "game_no")):
        assert got[n] == pytest.approx((beta[i], want[i]), rel=1e-5)


def _newton(rows):
    """One fit by dense Newton steps. rows: x0, x1, x2, won, n."""
    r = np.array(rows, float)
    x, won, n, b = r[:, :3], r[:, 3], r[:, 4], np.zeros(3)
    for _ in range(6):
        p = 1 / (1 + np.exp(-x @ b))
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(3)
        b = b + np.linalg.solve(h, x.T @ (won - n * p))
    return [*b, *np.sqrt(np.diag(np.linalg.inv(h)))]


def test_keyed_fits_equal_single_ones(spark):
    rng = np.random.default_rng(1)
    rows = [(k, 1.0, float(x1), float(x2), float(rng.binomial(n, 0.6)), float(n)) for k in range(30) for x1, x2, n in zip(rng.normal(size=25).round(3), rng.integers(0, 2, 25), rng.integers(1, 9, 25))]
    got = keyed_newton(spark.createDataFrame(rows, "key int, x0 double, x1 double, x2 double, won double, n double")).collect()
    assert len(got) == 30
    for r in got:
        assert list(r)[1:] == pytest.approx(_newton([x[1:] for x in rows if x[0] == r.key]), rel=1e-6, abs=1e-8)


def test_resamples_equal_single_ones(spark):
    cells = fitting._cells(fitting.forecasts(spark, SMALL), "match_id")
    by_match = {}
    for r in cells.collect():
        by_match.setdefault(r.match_id, []).append((r.x0, r.x1, r.x2, r.won, r.n))
    u = spark.createDataFrame([(m, k) for m in by_match for k in range(3)], "m long, k long").select("m", "k", (mixed(F.col("m") % _M, F.col("k")) / float(_M)).alias("u"))
    weight = {(r.m, r.k): sum(r.u >= c for c, _ in [(0.3678794, 0), (0.7357589, 1), (0.9196986, 2), (0.9810118, 3), (0.9963402, 4)]) for r in u.collect()}
    got = {r.key: list(r)[1:] for r in keyed_newton(fitting.resampled(cells, 3)).collect()}
    for k in range(3):
        own = [(*c[:3], c[3] * weight[m, k], c[4] * weight[m, k]) for m, cs in by_match.items() for c in cs if weight[m, k]]
        assert got[k] == pytest.approx(_newton(own), rel=1e-6)


def test_yearly_fits_equal_single_ones(spark):
    rows = fitting._cells(fitting.forecasts(spark, SMALL).withColumn("key", F.year("date")), "key").collect()
    for r in fitting.yearly_fits(spark, SMALL).collect():
        assert list(r)[1:7] == pytest.approx(_newton([(x.x0, x.x1, x.x2, x.won, x.n) for x in rows if x.key == r.year]), rel=1e-6)


def test_effects_without_rows(spark):
    none = games(spark, SMALL).where(F.lit(False)).withColumn("tour_level", F.lit(-1).cast("long"))
    assert effects.effects(none, fitting.SLOTS, ["margin"])[0].collect() == []


def test_race_fit_equals_a_grid_made_finer(spark):
    rows = [(r.total, r.gap, r.target, r.won, r.n) for r in fitting.race_cells(spark, SMALL).collect()]
    total, gap, target, won, n = (np.array(c, float) for c in zip(*rows))

    def nll(scale, gamma):
        p = 1 / (1 + np.exp(-(scale * total + gamma * gap)))
        q, win = 1 - p, np.zeros_like(p)
        for t in (11, 15):
            at = target == t
            a, b = p[at], q[at]
            win[at] = sum(comb(t - 1 + k, k) * a**t * b**k for k in range(t - 1)) + comb(2 * t - 2, t - 1) * (a * b) ** (t - 1) * a * a / (a * a + b * b)
        win = np.clip(win, 1e-9, 1 - 1e-9)
        return -(won * np.log(win) + (n - won) * np.log(1 - win)).sum()

    x, step = (0.0, 0.0), 0.2
    while step > 1e-6:
        near = [(x[0] + i * step, x[1] + j * step) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        best = min(near, key=lambda c: nll(*c))
        x, step = best, step if best != x else step / 2
    got = fitting.race_fit(spark, SMALL).first()
    assert (got.scale, got.gamma) == pytest.approx(x, abs=1e-3) and got.nll == pytest.approx(nll(*x) / n.sum(), rel=1e-8)


def test_simplex_of_three(spark):
    rows = spark.range(50).select((F.col("id") / 10.0).alias("t"))
    truth = [1.5, -0.7, 0.3]
    loss = lambda x: F.pow(F.lit(truth[0] - x[0]) + (truth[1] - x[1]) * F.col("t") + F.lit(truth[2] - x[2]) * F.sin("t"), 2) + F.lit((x[0] - 1.5) ** 2)
    x, least, _ = simplex.nelder_mead(rows, loss, [0.0, 0.0, 0.0], size=1.0, steps=200)
    assert x == pytest.approx(truth, abs=1e-3) and least < 1e-5
