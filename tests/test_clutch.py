"""Clutch scores against the definition and all deals; scores of deciders against a walk back from the end."""
import itertools
import math
import statistics
from collections import defaultdict
from functools import lru_cache

import pytest

from courtside import catalog
from courtside.operators import serve
from courtside.operators.clutch import clutch_scores, durability_scores, month_halves, summed, trait_summary
from courtside.sources.logs import log_rows

from .conftest import SMALL


def chances(eta, k=0.43):
    r, base = math.sqrt(math.exp(eta)), k / (1 - k)
    return base * r / (1 + base * r), base / r / (1 + base / r)


def rallies_of(spark):
    """(server, match, swing, won less expected) of each readable rally, row by row."""
    by_match, tables = defaultdict(list), {}
    for r in log_rows(spark, SMALL).orderBy("match_id", "log_index").collect():
        by_match[r.match_id].append(r)
    rated = lambda u: u * 37 % 101 / 100 - 0.5
    for m, rows in by_match.items():
        u = 4 * m
        eta = round(rated(u) + rated(u + 1) - rated(u + 2) - rated(u + 3) + 1e-12, 1)
        if eta not in tables:
            tables[eta] = serve.serve_values(*chances(eta), 11)
        v, k = tables[eta], chances(eta)
        for r, after in itertools.pairwise(rows):
            if r.log_type != 12 or r.start_string.startswith("x"):
                continue
            own, other, number = map(int, r.start_string.split("-"))
            side = r.server_side
            a, b = (other, own) if side else (own, other)
            s = 2 * side + (number != 1)
            swing = abs((v[a, b + 1, s] if side else v[a + 1, b, s]) - v[a, b, (s + 1) % 4])
            yield r.server_uuid, m, swing, (after.log_type == 14) - k[side]


def test_clutch(spark):
    by_match, want = defaultdict(list), defaultdict(list)
    for server, m, swing, res in rallies_of(spark):
        by_match[m].append((server, swing, res))
    for m, rows in by_match.items():
        mean, sd = statistics.fmean(x[1] for x in rows), statistics.pstdev(x[1] for x in rows)
        if sd >= 1e-9:
            for server, swing, res in rows:
                want[server].append((m, (swing - mean) / sd, res))
    want = {s: x for s, x in want.items() if len(x) >= 10}
    got = {r.server: r for r in catalog.QUERIES["clutch"](spark, SMALL).collect()}
    assert want and got.keys() == want.keys()
    for s, rows in want.items():
        place = {m: i for i, m in enumerate(sorted({x[0] for x in rows}))}
        half = lambda k: [x * y for m, x, y in rows if place[m] % 2 == k]  # noqa: E731, B023
        assert got[s].n == len(rows) and got[s].clutch == pytest.approx(statistics.fmean(x * y for _, x, y in rows))
        for mine, values in ((got[s].half1, half(0)), (got[s].half2, half(1))):
            assert mine == pytest.approx(statistics.fmean(values)) if values else mine is None


def test_spread_is_that_of_all_deals(spark):
    x, y = [0.5, -1.2, 2.0, 0.1, -0.4, 0.5], [0.6, -0.4, 0.6, -0.4, -0.4, 0.6]
    rows = [("p", i % 3, a, b) for i, (a, b) in enumerate(zip(x, y))] + [("one", 1, 1.0, 0.5), ("flat", 1, 0.3, 0.5), ("flat", 2, 0.3, -0.5)]
    got = {r.server: r for r in clutch_scores(spark.createDataFrame(rows, "server string, match_id long, lz double, res double"), least=1).collect()}
    deals = [statistics.fmean(a * b for a, b in zip(p, y)) for p in itertools.permutations(x)]
    assert got["p"].null_sd == pytest.approx(statistics.pstdev(deals)) and got["p"].z == pytest.approx(statistics.fmean(a * b for a, b in zip(x, y)) / statistics.pstdev(deals))
    assert got["p"].half1 == pytest.approx(statistics.fmean(a * b for i, (a, b) in enumerate(zip(x, y)) if i % 3 != 1))
    assert (got["one"].z, got["one"].half2, got["flat"].z) == (0.0, None, 0.0)


def test_summary(spark):
    scores = [(f"p{i}", i * 0.01 - 0.05 + (i % 3) * 0.02, 0.02 + i % 2 * 0.01, (i % 4) * 0.1, (i % 5) * 0.1 if i else None, i * 0.1) for i in range(14)]
    df = spark.createDataFrame([(s, c, n, c / n, a, b, v) for s, c, n, a, b, v in scores], "server string, clutch double, null_sd double, z double, half1 double, half2 double, value double")
    r = trait_summary(df, "clutch").first()
    z = [c / n for _, c, n, *_ in scores]
    line = statistics.linear_regression([x[5] for x in scores], [x[1] for x in scores])
    rest = [(c - line.intercept - line.slope * v) / n for _, c, n, _, _, v in scores]
    halves = [(a, b) for *_, a, b, _ in scores if b is not None]
    assert r.players == 14 and r.z_mean == pytest.approx(statistics.fmean(z)) and r.z_var == pytest.approx(statistics.pvariance(z)) and r.z_var_rest == pytest.approx(statistics.pvariance(rest))
    assert r.half_r == pytest.approx(statistics.correlation(*zip(*halves))) and r.value_r == pytest.approx(statistics.correlation([x[1] for x in scores], [x[5] for x in scores]))
    assert r.trend == pytest.approx(line.slope)
    fit = [line.intercept + line.slope * x[5] for x in scores]
    apart = [(x[3] - f, x[4] - f) for x, f in zip(scores, fit) if x[4] is not None]
    assert r.half_r_rest == pytest.approx(statistics.correlation(*zip(*apart)))
    few = trait_summary(df.limit(5), "clutch").first()
    assert few.players == 5 and few.half_r is few.value_r is few.z_var_rest is None
    assert trait_summary(df.limit(0), "clutch").first().players == 0


def test_durability_spread_is_that_of_all_deals(spark):
    x, y = [0.5, -1.2, 2.0, 0.1, -0.4, 0.5], [0.1, -0.2, 0.3, 0.05, 0.0, -0.1]
    rows = [("p", a, b, 1 + (i >= 3)) for i, (a, b) in enumerate(zip(x, y))] + [("same", 1.0, b, 1) for b in y] + [("few", a, b, 2) for a, b in zip(x[:2], y)] + [("half", a, b, 1 if a == 0.5 else 2) for a, b in zip(x, y)]
    got = {r.player: r for r in durability_scores(spark.createDataFrame(rows, "player string, x double, y double, half int"), least=3).collect()}
    deals = [statistics.linear_regression(x, p).slope for p in itertools.permutations(y)]
    assert got.keys() == {"p", "half"} and got["p"].n == 6
    assert got["p"].null_sd == pytest.approx(statistics.pstdev(deals)) and got["p"].slope == pytest.approx(statistics.linear_regression(x, y).slope) and got["p"].z == pytest.approx(got["p"].slope / statistics.pstdev(deals))
    assert got["p"].half1 == pytest.approx(statistics.linear_regression(x[:3], y[:3]).slope) and got["p"].half2 == pytest.approx(statistics.linear_regression(x[3:], y[3:]).slope)
    assert got["half"].half1 is None


def test_decider_scores(spark):
    by = defaultdict(dict)
    for r in catalog.QUERIES["decider_score_chances"](spark, SMALL).collect():
        by[tuple(r.ps)][r.a, r.b] = r.chance
    margins = {tuple(r.ps): r for r in catalog.QUERIES["decider_states"](spark, SMALL).collect()}
    assert by.keys() == margins.keys()
    for ps, scores in by.items():
        assert sum(scores.values()) == pytest.approx(1, abs=1e-9) and sum((a - b) * p for (a, b), p in scores.items()) == pytest.approx(margins[ps].margin, abs=1e-9)
        assert sum(p * ((a > b) + (a == b) / 2) for (a, b), p in scores.items() if abs(a - b) != 1) + sum(p / 2 for (a, b), p in scores.items() if abs(a - b) == 1) == pytest.approx(margins[ps].frozen, abs=1e-9)

    # the expected product of a last score, from the end backwards
    for ps in list(by)[:8]:

        @lru_cache(maxsize=None)
        def value(a, b, server):
            top, lead = max(a, b), abs(a - b)
            if top >= serve.CAP or top >= serve.DECIDER and lead >= 2:
                return float(a * b)
            p = ps[(a + b) // serve.EVERY % 4]  # noqa: B023
            to = lambda x, y, s, wins, side: value(a, b, s) if wins and server != side else value(x, y, s)
            return p * to(a + 1, b, 0, a + 1 >= serve.DECIDER and a - b >= 1, 0) + (1 - p) * to(a, b + 1, 1, b + 1 >= serve.DECIDER and b - a >= 1, 1)

        assert sum(a * b * p for (a, b), p in by[ps].items()) == pytest.approx((value(0, 0, 0) + value(0, 0, 1)) / 2, abs=1e-7)


def test_halves_that_meet_in_a_month(spark):
    """An odd row is of the later half; a month is cut where the halves meet in it, and one that ends with the earlier half is not."""
    rows = [("a", 1, 1.0, 0.5), ("a", 1, 2.0, 0.1), ("a", 2, 3.0, 0.2), ("a", 2, 5.0, 0.9), ("a", 3, 4.0, 0.3), ("b", 7, 1.0, 0.1), ("b", 8, 2.0, 0.2)] + [("c", 4, float(k), 0.0) for k in range(5)]
    sums = summed(spark.createDataFrame(rows, "player string, month int, opp double, y double"), "player", "month")
    got = {(r.player, r.month): (r.half, r.take) for r in month_halves(sums).collect()}
    assert {k: h for k, (h, _) in got.items()} == {("a", 1): 1, ("a", 2): 2, ("a", 3): 2, ("b", 7): 1, ("b", 8): 2, ("c", 4): None} and got["c", 4][1] == 2
