"""What SQL can't express, against plain recursions and walks in Python."""
import math
from collections import defaultdict
from functools import lru_cache

import pytest

from courtside import catalog
from courtside.operators import serve
from courtside.operators.fits import logistic_newton, paired_map, served_map
from courtside.operators.rally import elo_sweep
from courtside.sources.logs import log_rows
from courtside.sources.tables import games, rallies

from .conftest import SMALL


def run(spark, name):
    return catalog.QUERIES[name](spark, SMALL).collect()


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def serve_chances(eta, k):
    r, base = math.sqrt(math.exp(eta)), k / (1 - k)
    return base * r / (1 + base * r), (base / r) / (1 + base / r)


def simulated_serve(ka, kb, target, a, b, s, depth=0):
    """Rally by rally; passing the serve on is followed until it hardly matters."""
    if max(a, b) >= target and abs(a - b) >= 2:
        return float(a > b)
    if depth > 40 or max(a, b) > target + 6:
        return 0.5
    k = ka if s < 2 else kb
    won = _memo(ka, kb, target, a + (s < 2), b + (s >= 2), s)
    return k * won + (1 - k) * simulated_serve(ka, kb, target, a, b, (s + 1) % 4, depth + 1)


@lru_cache(maxsize=None)
def _memo(ka, kb, target, a, b, s):
    return simulated_serve(ka, kb, target, a, b, s)


def test_serve_states(spark):
    by = defaultdict(dict)
    for r in run(spark, "serve_states"):
        by[r.eta][r.a, r.b, r.s] = r
    assert len(by) == 5
    for eta, rows in by.items():
        ka, kb = serve_chances(eta, 0.43)
        for (a, b, s), r in rows.items():
            assert (r.ka, r.kb) == pytest.approx((ka, kb))
            if a <= 11 and b <= 11 and (a, b) in {(0, 0), (9, 10), (10, 10), (3, 7), (11, 4)}:
                assert r.v == pytest.approx(simulated_serve(ka, kb, 11, a, b, serve.STATES.index(s)), abs=2e-3)
    # sides changed, the chance is the other one's
    for (a, b, s), r in by[0.0].items():
        mirrored = by[0.0][b, a, ("B" if s[0] == "A" else "A") + s[1]]
        assert r.v + mirrored.v == pytest.approx(1)
    assert serve.serve_values(0.443, 0.443, 11)[9, 10, 0] == pytest.approx(0.46655, abs=1e-5)


def test_biggest_points(spark):
    v = {(r.a, r.b, r.s): r.v for r in run(spark, "serve_states") if abs(r.eta) < 1e-9}
    swing = {}
    for (a, b, s) in v:
        if max(a, b) < 11:
            won = v[a + (s[0] == "A"), b + (s[0] == "B"), s]
            lost = v[a, b, {"A1": "A2", "A2": "B1", "B1": "B2", "B2": "A1"}[s]]
            swing[a, b, s] = abs(won - lost)
    best = sorted(swing, key=lambda x: (-swing[x], x))[:6]
    got = run(spark, "biggest_points")
    assert {(r.a, r.b, r.s) for r in got} == set(best)
    assert all(r.swing == pytest.approx(swing[r.a, r.b, r.s]) for r in got)


def test_rally_race(spark):
    @lru_cache(maxsize=None)
    def chance(p, a, b):
        if max(a, b) >= 21 and abs(a - b) >= 2:
            return float(a > b)
        if max(a, b) > 60:
            return p * p / (p * p + (1 - p) ** 2)
        return p * chance(p, a + 1, b) + (1 - p) * chance(p, a, b + 1)

    rows = run(spark, "rally_race_states")
    assert rows
    for r in rows:
        # tables end at the target; 21-20 and its like are within them
        assert r.v == pytest.approx(chance(r.p, r.a, r.b), abs=1e-6)


def test_anchors(spark):
    for r in run(spark, "serve_anchors"):
        assert serve.start_chance(serve.serve_values(*serve_chances(r.eta, 0.43), 11)) == pytest.approx(r.p, abs=1e-6)

    def win(x):
        return sum(math.comb(20 + b, b) * x**21 * (1 - x) ** b for b in range(20)) + math.comb(40, 20) * (x * (1 - x)) ** 20 * x * x / (x * x + (1 - x) ** 2)

    for r in run(spark, "rally_anchors"):
        assert win(r.rally) == pytest.approx(r.p, abs=1e-6)


def test_mixed_serve_states(spark):
    rows = {(r.eta, r.sd, r.a, r.b, r.s): r.v for r in run(spark, "mixed_serve_states")}
    for eta, sd in {k[:2] for k in rows}:
        z = [-3 + i * 0.3 for i in range(21)]
        w = [math.exp(-x * x / 2) for x in z]
        tables = [serve.serve_values(*serve_chances(eta + x * sd, 0.43), 11) for x in z]
        for a, b, s in ((0, 0, 1), (5, 9, 2), (10, 10, 0)):
            want = sum(p * t[a, b, s] for p, t in zip(w, tables)) / sum(w)
            assert rows[eta, sd, a, b, serve.STATES[s]] == pytest.approx(want, abs=1e-7)


def test_first_server(spark):
    def effect(eta, target):
        v = serve.serve_values(*serve_chances(eta, 0.43), target)
        return v[0, 0, 1] - v[0, 0, 3]

    rows = run(spark, "first_server_effect")
    matches = {r.match_id for r in log_rows(spark, SMALL).select("match_id").distinct().collect()}
    assert sorted((r.match_id, r.target) for r in rows) == sorted((m, t) for m in matches for t in (11, 15))
    for r in rows:
        assert r.effect == pytest.approx(effect(r.eta, r.target), abs=1e-9) and r.between_equals == pytest.approx(effect(0.0, r.target), abs=1e-9)


def test_deciders(spark):
    def plain(ps):
        @lru_cache(maxsize=None)
        def v(a, b):
            if max(a, b) >= 21 and abs(a - b) >= 2:
                return float(a > b)
            if max(a, b) >= serve.CAP:
                return 0.5
            p = ps[(a + b) // 4 % 4]
            return p * v(a + 1, b) + (1 - p) * v(a, b + 1)

        return v(0, 0)

    def frozen(ps):
        @lru_cache(maxsize=None)
        def v(a, b, server):
            if max(a, b) >= 21 and abs(a - b) >= 2:
                return float(a > b)
            if max(a, b) >= serve.CAP:
                return 0.5
            p = ps[(a + b) // 4 % 4]
            by_a = v(a, b, 0) if server == 1 and a + 1 >= 21 and a + 1 - b >= 2 else v(a + 1, b, 0)
            by_b = v(a, b, 1) if server == 0 and b + 1 >= 21 and b + 1 - a >= 2 else v(a, b + 1, 1)
            return p * by_a + (1 - p) * by_b

        return (v(0, 0, 0) + v(0, 0, 1)) / 2

    rows = run(spark, "decider_states")
    assert len(rows) > 100
    for r in rows[:40]:
        ps = tuple(r.ps)
        assert r.plain == pytest.approx(plain(ps), abs=1e-9)
        assert r.frozen == pytest.approx(frozen(ps), abs=1e-9)
        _, final, slots = serve.decider(ps, True)
        assert final.sum() == pytest.approx(1) and slots.tolist() == pytest.approx(r.rallies)
        assert sum(serve.decider(ps, False)[2]) == pytest.approx(sum((a + b) * x for (a, b), x in __import__("numpy").ndenumerate(serve.decider(ps, False)[1])))
    even = serve.decider((0.5,) * 4, True)
    assert even[0] == pytest.approx(0.5)


def test_log_win_series(spark):
    rated = lambda u: u * 37 % 101 / 100 - 0.5
    tables, want = {}, {}
    for r in log_rows(spark, SMALL).where("log_type = 12").collect():
        parts = r.start_string.split("-")
        if parts[0] != "x":
            own, other, number = map(int, parts)
            a, b = (own, other) if r.server_side == 0 else (other, own)
            m = 4 * r.match_id
            eta = round(rated(m) + rated(m + 1) - rated(m + 2) - rated(m + 3) + 1e-12, 1)
            v = tables.setdefault(eta, serve.serve_values(*serve_chances(eta, 0.43), 11))
            want[r.log_index] = v[a, b, 2 * r.server_side + (number != 1)]
    got = {r.log_index: r.p for r in run(spark, "log_win_series")}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_log_walk(spark):
    """The walk again with stacks and dictionaries, row by row."""
    logs = defaultdict(list)
    for r in log_rows(spark, SMALL).orderBy("log_index").collect():
        logs[r.match_id].append(r)

    def first(text, i=0):
        try:
            return int(text.split("-")[i])
        except (ValueError, IndexError):
            return None

    def delta(r):
        payload = None if r.point_end is None else r.point_end - (r.point_end - 1 if r.point_start is None else r.point_start)
        a, b = first(r.start_string), first(r.end_string)
        string = None if a is None or b is None else b - a
        options = [d for d in (string, payload) if d is not None]
        return min(options, key=abs) if options else 0

    want = []
    for match, rows in logs.items():
        side_of_team = {}
        for r in rows:
            if r.log_type == 14 and r.team_uuid and delta(r) > 0:
                side_of_team.setdefault(r.team_uuid, r.server_side)
        score, events, stacks, opened = defaultdict(lambda: [0, 0]), [], ([], []), None
        for i, r in enumerate(rows):
            if r.log_type == 12:
                opened = r
                continue
            if r.log_type not in (14, 16, 23):
                continue
            who = opened or r
            game = r.game_number if r.log_type == 14 else who.game_number
            side = side_of_team.get(r.team_uuid, who.server_side) if r.log_type == 14 else who.server_side
            d = 0
            if r.log_type == 14:
                d = delta(r)
                if d == 0 and r.point_end is not None and first(r.start_string) is not None:
                    for later in rows[i + 1 :]:
                        if first(later.start_string) is not None:
                            d = int(first(later.start_string, 1 if later.log_type == 16 else 0) == first(r.start_string) + 1)
                            break
            if opened and (r.log_type != 14 or d > 0):
                events.append([match, game, opened.server_uuid.lower(), side, {14: "point", 16: "sideout", 23: "second"}[r.log_type], int(r.log_type == 14), score[game][side], score[game][1 - side]])
                if r.log_type == 14:
                    stacks[side].append(events[-1])
            if r.log_type == 14:
                score[game][side] += d
                if d > 0 and r.point_start is not None and first(r.start_string) is not None and 0 < r.point_start - first(r.start_string) < 15:
                    score[game][side] += r.point_start - first(r.start_string)
                for _ in range(-d):
                    if stacks[side]:
                        stacks[side].pop()[5] = 0
            opened = None
        want += events
    got = [[r.match_id, r.game, r.server, r.side, r.outcome, r.won, r.server_score, r.receiver_score] for r in run(spark, "log_rally_events")]
    assert sorted(got) == sorted(want) and any(not e[5] and e[4] == "point" for e in want)


def test_serve_state_walk(spark):
    logs = defaultdict(list)
    for r in log_rows(spark, SMALL).where("log_type in (12, 14, 16, 23)").orderBy("log_index").collect():
        logs[r.match_id, r.game_number].append(r)
    archived = {k: [sum(r.log_type == 14 and r.server_side == s for r in rows) for s in (0, 1)] for k, rows in logs.items()}
    want = []
    for key, rows in logs.items():
        score, state, opened, seen, bad = [0, 0], None, None, [], False
        for r in rows:
            if r.log_type == 12:
                opened = r
                continue
            if opened is None:
                continue
            side = opened.server_side
            if state is None or state // 2 != side:
                state = 2 * side + 1
            seen.append((*key, r.log_index, *score, state, opened.server_uuid.lower(), side, int(r.log_type == 14)))
            if r.log_type == 14:
                score[side] += 1
            elif r.log_type == 23:
                if state % 2:
                    bad = True
                    break
                state += 1
            else:
                state = 2 if state < 2 else 0
            opened = None
        if not bad and (key[0] % 2 or score == archived[key]):
            want += seen
    assert want and sorted(tuple(r) for r in run(spark, "log_serve_states")) == sorted(want)


def test_retractions(spark):
    stacks, back = defaultdict(list), defaultdict(int)
    matches = set()
    for r in rallies(spark, SMALL).where("log_type = 14").orderBy("log_index").collect():
        matches.add(r.match_id)
        if r.k >= 5:
            stacks[r.match_id, r.side].append(r.log_index)
        elif stacks[r.match_id, r.side]:
            stacks[r.match_id, r.side].pop()
            back[r.match_id, r.side] += 1
    want = sorted((m, s, len(stacks[m, s]), back[m, s]) for m in matches for s in (0, 1))
    assert sorted((r.match_id, r.side, r.points, r.taken_back) for r in run(spark, "retractions")) == want


def test_elo(spark):
    ratings = defaultdict(float)
    for g in sorted(games(spark, SMALL).where("not is_forfeit").collect(), key=lambda g: (g.context, g.date, g.gid)):
        own = lambda p: (g.context, p)
        gap = ratings[own(g.a1)] + ratings[own(g.a2)] - ratings[own(g.b1)] - ratings[own(g.b2)]
        step = 24 * ((g.margin > 0) - 1 / (1 + 10 ** (-gap / 800)))
        for p, sign in ((g.a1, 1), (g.a2, 1), (g.b1, -1), (g.b2, -1)):
            ratings[own(p)] += sign * step
    got = {(r.context, r.player): r.rating for r in run(spark, "elo")}
    assert got.keys() == ratings.keys() and all(got[k] == pytest.approx(ratings[k]) for k in got)


def test_newton(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.c_[np.ones(400), rng.normal(size=(400, 2))]
    y = (rng.random(400) < 1 / (1 + np.exp(-x @ [0.2, 1.0, -0.5]))).astype(float)
    got = logistic_newton(spark.createDataFrame([(float(b), [float(v) for v in a]) for a, b in zip(x, y)], "y double, x array<double>"), ["c", "u", "v"]).collect()
    beta = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ beta))
        hess = (x * (p * (1 - p))[:, None]).T @ x
        beta += np.linalg.solve(hess, x.T @ (y - p))
    assert [r.estimate for r in got] == pytest.approx(beta.tolist(), abs=1e-5)
    assert [r.se for r in got] == pytest.approx(np.sqrt(np.diag(np.linalg.inv(hess))).tolist(), rel=1e-4)


def test_paired_map(spark):
    met = [(1, 2, 7, 10), (2, 3, 6, 10), (1, 3, 9, 10), (3, 4, 5, 8)]
    got = {r.player: r.value for r in paired_map(spark.createDataFrame(met, "a long, b long, won long, n long"), steps=60).collect()}
    # at the most likely values the slope is nought: wins less expected wins are the prior's pull
    for player, value in got.items():
        slope = sum((w if player == a else n - w) - n * sigmoid(value - got[b if player == a else a]) for a, b, w, n in met if player in (a, b))
        assert slope - value / 0.25 == pytest.approx(0, abs=1e-3)


def test_served_map(spark):
    met = [("a", "b", 6, 10), ("b", "a", 4, 12), ("a", "c", 7, 9), ("c", "b", 3, 8), ("c", "a", 5, 11), ("b", "c", 2, 7)]
    rows = served_map(spark.createDataFrame(met, "server string, receiver string, won long, n long"), steps=120).collect()
    alpha = [r.serve for r in rows if r.player is None][0]
    serving, returning = {r.player: r.serve for r in rows if r.player}, {r.player: r.back for r in rows if r.player}
    left = {(s, r): w - n * sigmoid(alpha + serving[s] - returning[r]) for s, r, w, n in met}
    # at the most likely values each slope is nought: what is left over is the prior's pull
    assert sum(left.values()) == pytest.approx(0, abs=1e-3)
    for p in "abc":
        assert sum(x for (s, _), x in left.items() if s == p) == pytest.approx(serving[p] / 0.0625, abs=1e-3)
        assert -sum(x for (_, r), x in left.items() if r == p) == pytest.approx(returning[p] / 0.0625, abs=1e-3)


def test_elo_steps(spark):
    own = games(spark, SMALL).where("not is_forfeit")
    played = sorted(own.collect(), key=lambda g: (g.context, g.date, g.gid))
    got = {r.k: r for r in elo_sweep(own, "context", [8.0, 32.0]).collect()}
    assert got.keys() == {8.0, 32.0}
    for k, r in got.items():
        ratings, loss = defaultdict(float), 0.0
        for g in played:
            four = [((g.context, p), sign) for p, sign in ((g.a1, 1), (g.a2, 1), (g.b1, -1), (g.b2, -1))]
            chance = 1 / (1 + 10 ** (-sum(sign * ratings[p] for p, sign in four) / 800))
            y = g.margin > 0
            loss -= math.log(max(chance if y else 1 - chance, 1e-6))
            for p, sign in four:
                ratings[p] += sign * k * (y - chance)
        assert r.games == len(played) and r.log_loss == pytest.approx(loss / len(played))
