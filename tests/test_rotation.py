"""Rotations walked row by row in plain Python, against the windows and the range join."""
import random


from pyspark.sql import functions as F

from courtside.operators import rotation
from courtside.operators.joins import in_ranges


def _walked(rows):
    """rows of one match in order: (pos, kind, side, player_in, player_out, delta, end). Points: what, before, after, gap, p0, p1."""
    court, out, pending = {}, {}, None
    for _, kind, side, _, player_out, _, _ in rows:
        if kind == "sub":
            court.setdefault(side, player_out)
    score = {0: 0, 1: 0}
    for pos, kind, side, player_in, _, delta, end in rows:
        if kind == "sub":
            court[side] = player_in
        elif kind == "rally":
            pending = (court.get(0), court.get(1))
        elif kind == "point":
            before, gap = score[side], 0
            if delta < 0:
                what, score[side] = "taken back", max(0, before + delta)
            elif end is None:
                what, score[side] = ("told" if delta else "nothing"), before + delta
            elif end == before + 1:
                what, score[side] = "normal", end
            elif end <= before:
                what = "twice"
            else:
                what, gap, score[side] = "gap", end - before - 1, end
            players = (None, None)
            if what in ("normal", "gap", "told"):
                players, pending = pending or (None, None), None
            out[pos] = (what, before, score[side], gap, *players)
    return out


def test_points_equal_a_walk(spark):
    rng, rows, want = random.Random(5), [], {}
    for match in range(40):
        own, score = [], {0: 0, 1: 0}
        for pos in range(1, rng.choice([3, 30, 300]) + 1):
            kind, side = rng.choice(["rally", "rally", "point", "point", "sub", "other"]), rng.randint(0, 1)
            score[side] = max(0, score[side] + rng.choice([1, 1, 1, 0, 2, -1]))
            own.append((pos, kind, side, f"p{side}{rng.randint(0, 3)}", f"p{side}{rng.randint(0, 3)}", rng.choice([1, 1, 1, 0, -1, 2]), rng.choice([score[side], score[side], None])))
        rows += [(match, *r, match * 1000 + r[0]) for r in own]
        want |= {(match, pos): x for pos, x in _walked(own).items()}
    df = spark.createDataFrame(rows, "match_id long, pos long, kind string, side int, player_in string, player_out string, delta int, end int, log_index long")
    subs = df.where("kind = 'sub'").select("match_id", "side", "pos", "player_in", "player_out")
    for width in (1, 7, rotation.WIDTH):
        got = {(r.match_id, r.pos): (r.what, r.before, r.after, r.gap, r.p0, r.p1) for r in rotation.attributed(df, subs, width).collect()}
        assert got == want


def test_ranges_meet_their_points_alone(spark):
    rng = random.Random(1)
    points = [(rng.randint(0, 2), rng.randint(-50, 300), i) for i in range(300)] + [(None, 3, 999)]
    ranges = [(rng.randint(0, 2), a, a + rng.randint(-3, 90), i) for i, a in enumerate(rng.choices(range(-60, 300), k=80))]
    p, r = spark.createDataFrame(points, "k int, at int, point int"), spark.createDataFrame(ranges, "k int, low int, high int, range int")
    want = sorted((i, j) for k, at, i in points for m, low, high, j in ranges if k == m and low <= at < high)
    for width in (1, 16, 1000):
        assert sorted((x.point, x.range) for x in in_ranges(p, r, ["k"], "at", "low", "high", width).collect()) == want


def test_no_subs_and_no_rows(spark):
    schema = "match_id long, pos long, kind string, side int, player_in string, player_out string, delta int, end int, log_index long"
    bare = spark.createDataFrame([(1, 1, "rally", 0, None, None, 0, None, 1), (1, 2, "point", 0, None, None, 1, 1, 2)], schema)
    subs = bare.where("kind = 'sub'").select("match_id", "side", "pos", "player_in", "player_out")
    assert [(r.what, r.after, r.p0) for r in rotation.attributed(bare, subs).collect()] == [("normal", 1, None)]
    assert rotation.attributed(bare.where(F.lit(False)), subs).collect() == []
