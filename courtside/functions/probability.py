"""Chances as column expressions: logistic, binomial races, best-of series, calibration, the normal distribution."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGMOID = "(1 / (1 + exp(-({x}))))"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def sigmoid(x) -> Column:
    """In the form that never takes the exponential of a large number."""
    x = _c(x)
    small = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def logit(p) -> Column:
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), _c(p)))
    return F.ln(p / (1 - p))


def comb(n, k) -> Column:
    """n over k by a product; factorial() ends at 20."""
    n = _c(n)
    return F.aggregate(F.sequence(F.lit(0), _c(k)), F.lit(1.0), lambda acc, i: F.when(i == 0, acc).otherwise(acc * (n - _c(k) + i) / i))


def race_pmf(p, target) -> Column:
    """array<struct<a, b, prob>>: exact scores of a race to `target` won by two: straight ends, and the mass that reaches deuce (a = b = target - 1)."""
    p, t = _c(p), _c(target)
    q = 1 - p
    lost = F.sequence(F.lit(0), t - 2)
    a = F.transform(lost, lambda b: F.struct(t.alias("a"), b.alias("b"), (comb(t - 1 + b, b) * F.pow(p, t) * F.pow(q, b)).alias("prob")))
    b = F.transform(lost, lambda a: F.struct(a.alias("a"), t.alias("b"), (comb(t - 1 + a, a) * F.pow(q, t) * F.pow(p, a)).alias("prob")))
    deuce = F.struct((t - 1).alias("a"), (t - 1).alias("b"), (comb(2 * t - 2, t - 1) * F.pow(p * q, t - 1)).alias("prob"))
    return F.concat(a, b, F.array(deuce))


def race_win(p, target) -> Column:
    """Chance to win the race: straight wins, and the deuce mass times p^2 / (p^2 + q^2)."""
    p, t = _c(p), _c(target)
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    q = 1 - p
    straight = F.aggregate(F.sequence(F.lit(0), t - 2), F.lit(0.0), lambda acc, b: acc + comb(t - 1 + b, b) * F.pow(p, t) * F.pow(q, b))
    return straight + comb(2 * t - 2, t - 1) * F.pow(p * q, t - 1) * p * p / (p * p + q * q)


def race_win_known(p: Column, target: Column, known: tuple[int, ...] = (11, 15)) -> Column:
    """race_win() with the coefficients of known targets written out, so that many different p cost a polynomial each; other targets as there."""
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    q = 1 - p

    def one(t: int) -> Column:
        straight = F.lit(float(math.comb(2 * t - 3, t - 2)))
        for b in reversed(range(t - 2)):
            straight = straight * q + float(math.comb(t - 1 + b, b))
        return F.pow(p, F.lit(t)) * straight + float(math.comb(2 * t - 2, t - 1)) * F.pow(p * q, F.lit(t - 1)) * p * p / (p * p + q * q)

    out = F
    for t in known:
        out = out.when(target == t, one(t))
    return out.otherwise(race_win(p, target))


def race_margin(p, target) -> Column:
    """Expected margin of the race; a race that goes beyond deuce ends two apart."""
    p, t = _c(p), _c(target)
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), p))
    q = 1 - p
    straight = F.aggregate(F.sequence(F.lit(0), t - 2), F.lit(0.0), lambda acc, b: acc + (t - b) * comb(t - 1 + b, b) * (F.pow(p, t) * F.pow(q, b) - F.pow(q, t) * F.pow(p, b)))
    deuce = comb(2 * t - 2, t - 1) * F.pow(p * q, t - 1)
    return straight + 2 * deuce * (p * p - q * q) / (p * p + q * q)


def race_modal(p, target) -> Column:
    """The likeliest straight score "a-b"; of equals the one with the winner first, fewest points first."""
    t = _c(target)
    ends = F.filter(race_pmf(p, target), lambda x: (x.a == t) | (x.b == t))
    best = F.aggregate(ends, F.struct(F.lit(-1).alias("a"), F.lit(-1).alias("b"), F.lit(0.0).alias("prob")), lambda acc, x: F.when(x.prob > acc.prob + 1e-12, F.struct(x.a.cast("int").alias("a"), x.b.cast("int").alias("b"), x.prob.alias("prob"))).otherwise(acc))
    return F.concat_ws("-", best.a, best.b)


#: Fixed value: what a pair loses for each unit by which its two players differ.
GAMMA = -0.1829


def team_eta(v1, v2, v3, v4, gamma: float = GAMMA) -> Column:
    """A rally's logit for the pair of 1 and 2 against that of 3 and 4."""
    return (v1 + v2 + gamma * F.abs(v1 - v2)) - (v3 + v4 + gamma * F.abs(v3 - v4))


def wins_pmf(chances: list) -> Column:
    """array: the chances of 0, 1, ... wins of independent games, each game's folded in by one pass over the array."""
    start = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), len(chances)))
    return F.aggregate(F.array(*map(_c, chances)), start, lambda pmf, p: F.transform(pmf, lambda x, i: x * (1 - p) + F.coalesce(F.get(pmf, i - 1), F.lit(0.0)) * p))


def floored(p, eps: float = 0.02118) -> Column:
    """Mixed with a coin: never 0 or 1."""
    return (1 - eps) * _c(p) + eps / 2


def percent(p) -> Column:
    """Whole percents as text, "<1%" and ">99%" at the ends."""
    r = F.round(_c(p) * 100)
    return F.when(r < 1, "<1%").when(r > 99, ">99%").otherwise(F.concat(r.cast("int"), F.lit("%")))


def calibrated(p, a: float = 0.06, b: float = 0.9, eps: float = 0.02118) -> Column:
    return (1 - eps) * sigmoid(a + b * logit(p)) + eps / 2


def best_of(p, n: int) -> Column:
    p = _c(p)
    return {3: p * p * (3 - 2 * p), 5: p * p * p * (10 - 15 * p + 6 * p * p)}[n]


def normal_cdf(x) -> Column:
    """Abramowitz and Stegun 7.1.26, to 1.5e-7: Spark has no erf."""
    x = _c(x)
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * z)
    tail = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-z * z)
    return F.when(x >= 0, 1 - tail / 2).otherwise(tail / 2)


_Z = "(abs({x}) / sqrt(2.0))"
_T = f"(1 / (1 + 0.3275911 * {_Z}))"
_TAIL = f"({_T} * (0.254829592 + {_T} * (-0.284496736 + {_T} * (1.421413741 + {_T} * (-1.453152027 + {_T} * 1.061405429)))) * exp(-{_Z} * {_Z}))"
NORMAL_CDF = f"(case when ({{x}}) >= 0 then 1 - {_TAIL} / 2 else {_TAIL} / 2 end)"


def odds(p) -> Column:
    p = F.greatest(F.lit(1e-9), F.least(F.lit(1 - 1e-9), _c(p)))
    return p / (1 - p)


def serve_chances(eta, k: float = 0.43) -> tuple[Column, Column]:
    """A rally's chances for each server, from the sides' difference: the odds of k are split by its root."""
    r, base = F.sqrt(odds(sigmoid(eta))), odds(F.lit(k))
    return base * r / (1 + base * r), (base / r) / (1 + base / r)
