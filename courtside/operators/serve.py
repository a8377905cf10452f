"""State tables of a race: built for each distinct argument and joined on the state."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from courtside.functions.probability import serve_chances

STATES = ("A1", "A2", "B1", "B2")


def serve_values(ka: float, kb: float, target: int, cap: int = 40) -> np.ndarray:
    """V[a, b, state]: side a's chance when only the server's side scores and each side has two servers.

    A server either scores and serves on at the next score, or hands the serve to the next server of the circle A1, A2, B1, B2. So at a score each server's
    chance is a line in that of the next one; the four lines, put into each other, make a line of the first server's chance in itself, whose fixed point it is.
    Scores are worked off from the end. Won by two; beyond target + cap even.
    """
    n = target + cap
    v = np.full((n + 2, n + 2, len(STATES)), 0.5)
    scores = [(ka, 1, 0)] * 2 + [(kb, 0, 1)] * 2
    for total in range(2 * n, -1, -1):
        for a in range(max(0, total - n), min(n, total) + 1):
            b = total - a
            if max(a, b) >= target and abs(a - b) >= 2:
                v[a, b] = float(a > b)
            elif max(a, b) < n:
                lines = [(k * v[a + da, b + db, s], 1 - k) for s, (k, da, db) in enumerate(scores)]
                height, slope = 0.0, 1.0
                for won, handed in lines:
                    height, slope = height + slope * won, slope * handed
                chance = height / (1 - slope)
                v[a, b, 0] = chance
                for s in (3, 2, 1):
                    chance = lines[s][0] + lines[s][1] * chance
                    v[a, b, s] = chance
    return v[: target + 2, : target + 2]


def serve_table(keys: DataFrame, target: int, k: float = 0.43) -> DataFrame:
    """(eta, ka, kb, a, b, s, v) for each distinct eta."""
    ka, kb = serve_chances(F.col("eta"), k)

    def tables(batches):
        for pdf in batches:
            for eta, x, y in pdf.itertuples(index=False):
                v = serve_values(x, y, target)
                a, b, s = (i.ravel() for i in np.indices(v.shape))
                yield pd.DataFrame({"eta": eta, "ka": x, "kb": y, "a": a, "b": b, "s": np.array(STATES)[s], "v": v.ravel()})

    return keys.select("eta", ka.alias("ka"), kb.alias("kb")).mapInPandas(tables, "eta double, ka double, kb double, a int, b int, s string, v double")


def leverage(states: DataFrame) -> DataFrame:
    """Each state's swing: what a won rally is worth against a lost one, by joins with the states that follow."""
    c = F.col
    state = c("s")
    # a point for the serving side keeps its server; a lost rally passes the serve on
    after_win = F.struct((c("a") + F.when(state.startswith("A"), 1).otherwise(0)).alias("a"), (c("b") + F.when(state.startswith("B"), 1).otherwise(0)).alias("b"), state.alias("s"))
    passed = F.when(state == "A1", "A2").when(state == "A2", "B1").when(state == "B1", "B2").otherwise("A1")
    live = states.where("greatest(a, b) < 11").select("eta", "a", "b", "s", after_win.alias("w"), passed.alias("l"))
    to = states.select(c("eta").alias("e"), c("a").alias("ta"), c("b").alias("tb"), c("s").alias("ts"), "v")
    won = live.join(to, (c("eta") == c("e")) & (c("w.a") == c("ta")) & (c("w.b") == c("tb")) & (c("w.s") == c("ts"))).select("eta", "a", "b", "s", "l", c("v").alias("v_won"))
    both = won.join(to, (c("eta") == c("e")) & (c("a") == c("ta")) & (c("b") == c("tb")) & (c("l") == c("ts")))
    return both.select("eta", "a", "b", "s", F.abs(c("v_won") - c("v")).alias("swing"))


def rally_race(keys: DataFrame, target: int) -> DataFrame:
    """(p, a, b, v): the chance from each score of a race in which every rally scores, won by two."""

    def tables(batches):
        for pdf in batches:
            for p in pdf["p"]:
                v = np.zeros((target + 1, target + 1))
                even = p * p / (p * p + (1 - p) * (1 - p))
                for total in range(2 * target, -1, -1):
                    for a in range(max(0, total - target), min(target, total) + 1):
                        b = total - a
                        if a >= target - 1 and b >= target - 1:  # from deuce on it is about two in a row
                            v[a, b] = even if a == b else (p + (1 - p) * even if a > b else p * even)
                        elif max(a, b) == target:
                            v[a, b] = float(a > b)
                        else:
                            v[a, b] = p * v[a + 1, b] + (1 - p) * v[a, b + 1]
                a, b = (i.ravel() for i in np.indices(v.shape))
                yield pd.DataFrame({"p": p, "a": a, "b": b, "v": v.ravel()})

    return keys.mapInPandas(tables, "p double, a int, b int, v double")


def start_chance(v: np.ndarray) -> float:
    """Before the first rally: games open on a side's second server, either side's with even chance."""
    return float(v[0, 0, 1] + v[0, 0, 3]) / 2


def bisected(f, goal: float, low: float, high: float, steps: int = 40) -> float:
    """Where the rising function f reaches goal."""
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < goal else (low, mid)
    return (low + high) / 2


def anchored(goals: DataFrame, target: int, k: float = 0.43) -> DataFrame:
    """(p, eta): for each distinct chance p the difference at which the serve-aware race starts with that chance."""

    def serve(eta: float) -> np.ndarray:
        r, base = np.exp(eta / 2), k / (1 - k)
        return serve_values(base * r / (1 + base * r), base / r / (1 + base / r), target)

    def solve(batches):
        for pdf in batches:
            yield pd.DataFrame({"p": pdf["p"], "eta": [bisected(lambda x: start_chance(serve(x)), min(max(p, 1e-6), 1 - 1e-6), -8.0, 8.0, 30) for p in pdf["p"]]})

    return goals.select("p").distinct().repartition("p").mapInPandas(solve, "p double, eta double")


def mixed_serve_table(keys: DataFrame, target: int, nodes: int = 21) -> DataFrame:
    """(eta, sd, a, b, s, v): the serve table averaged over a normal eta, out to three deviations."""
    z = -3.0 + F.col("i") * (6.0 / (nodes - 1))
    points = keys.select("eta", "sd", F.explode(F.sequence(F.lit(0), F.lit(nodes - 1))).alias("i")).withColumn("w", F.exp(-0.5 * z * z)).withColumn("at", F.round(F.col("eta") + z * F.col("sd"), 9))
    tables = serve_table(points.select(F.col("at").alias("eta")).distinct(), target).withColumnRenamed("eta", "at").select("at", "a", "b", "s", "v")
    return points.join(tables, "at").groupBy("eta", "sd", "a", "b", "s").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("v"))


def rally_chance(goals: DataFrame, target: int = 21) -> DataFrame:
    """(p, rally): the rally chance at which a race in which every rally scores is won with chance p."""
    from math import comb

    def win(x: float) -> float:
        y = 1 - x
        return sum(comb(target - 1 + b, b) * x**target * y**b for b in range(target - 1)) + comb(2 * target - 2, target - 1) * (x * y) ** (target - 1) * x * x / (x * x + y * y)

    def solve(batches):
        for pdf in batches:
            yield pd.DataFrame({"p": pdf["p"], "rally": [bisected(win, p, 1e-4, 1 - 1e-4) for p in pdf["p"]]})

    return goals.select("p").distinct().mapInPandas(solve, "p double, rally double")


#: Fixed values of a decider: the target, won by two, rallies before the next pair of players steps in, and where a score counts as even.
DECIDER, EVERY, CAP = 21, 4, 61


def decider(ps: tuple, freeze: bool, cap: int = CAP) -> tuple[float, np.ndarray, np.ndarray]:
    """(chance of the first side, final[a, b] chances of each last score, expected rallies of each slot).

    ps: the first side's rally chances of the four slots, which take turns every EVERY points. freeze: a rally won by the receivers that would
    win the decider gives them the serve alone; either side serves first with even chance. As the slot follows from the score,
    a state is a score and who serves; frozen rallies stay at their score, where the two servers' chances are solved as a pair of lines.
    """
    n = cap + 1
    over = lambda a, b: max(a, b) >= DECIDER and abs(a - b) >= 2
    reach = np.zeros((n + 1, n + 1, 2))
    reach[0, 0] = 0.5
    final, slots = np.zeros((n + 1, n + 1)), np.zeros(4)
    for total in range(2 * n):
        for a in range(max(0, total - n), min(n, total) + 1):
            b = total - a
            here = reach[a, b]
            if not here.any():
                continue
            if over(a, b) or max(a, b) >= cap:
                final[a, b] += here.sum()
                continue
            slot = total // EVERY % 4
            p = ps[slot]
            # visits of each server at this score: a frozen rally brings the other one back
            to_a = p if freeze and over(a + 1, b) else 0.0
            to_b = 1 - p if freeze and over(a, b + 1) else 0.0
            by_a = (here[0] + to_a * here[1]) / (1 - to_a * to_b)
            by_b = (here[1] + to_b * here[0]) / (1 - to_a * to_b)
            slots[slot] += by_a + by_b
            reach[a + 1, b, 0] += p * by_a + (p - to_a) * by_b
            reach[a, b + 1, 1] += (1 - p) * by_b + (1 - p - to_b) * by_a
    a, b = np.indices(final.shape)
    even = np.maximum(a, b) >= cap
    decided = final * (np.maximum(a, b) >= DECIDER) * (np.abs(a - b) >= 2) * (a > b)
    return float(decided.sum() + 0.5 * (final * (even & (np.abs(a - b) < 2))).sum()), final, slots


def deciders(keys: DataFrame) -> DataFrame:
    """keys: ps (array of four). With and without freeze: the chance, the first server's share of it, the expected margin and rallies of each slot."""

    def solve(batches):
        for pdf in batches:
            out = []
            for ps in pdf["ps"]:
                plain, _, _ = decider(tuple(ps), False)
                frozen, final, slots = decider(tuple(ps), True)
                a, b = np.indices(final.shape)
                out.append((list(ps), plain, frozen, float((final * (a - b)).sum()), slots.tolist()))
            yield pd.DataFrame(out, columns=["ps", "plain", "frozen", "margin", "rallies"])

    return keys.select("ps").distinct().mapInPandas(solve, "ps array<double>, plain double, frozen double, margin double, rallies array<double>")


def decider_scores(keys: DataFrame) -> DataFrame:
    """keys: ps (array of four). (ps, a, b, chance) of each last score that a decider with freeze can end in; the chances of a decider sum to 1."""

    def solve(batches):
        for pdf in batches:
            for ps in pdf["ps"]:
                _, final, _ = decider(tuple(ps), True)
                a, b = np.nonzero(final)
                yield pd.DataFrame({"ps": [list(ps)] * len(a), "a": a, "b": b, "chance": final[a, b]})

    return keys.select("ps").distinct().mapInPandas(solve, "ps array<double>, a int, b int, chance double")
