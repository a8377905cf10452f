"""Brackets of any size against a recursion over the template."""
import math

import pytest

from courtside.operators.brackets import bracket


def _dealt(seeds):
    """Seeds by place: dealt to the two halves in snake order, each half likewise."""
    if len(seeds) == 1:
        return seeds
    left = [s for i, s in enumerate(seeds) if i % 4 in (0, 3)]
    return _dealt(left) + _dealt([s for s in seeds if s not in left])


def _through(values):
    """{(seed, round): chance} by a recursion from the final down."""
    rounds = math.ceil(math.log2(len(values))) if len(values) > 1 else 0
    places, out = _dealt(list(range(1, 2**rounds + 1))), {}

    def part(lo, hi):
        if hi - lo == 1:
            return {places[lo]: 1.0} if places[lo] <= len(values) else {}
        left, right, size = part(lo, (lo + hi) // 2), part((lo + hi) // 2, hi), int(math.log2(hi - lo))
        won = {}
        for own, other in ((left, right), (right, left)):
            for a, p in own.items():
                won[a] = p * (sum(q / (1 + math.exp(values[b - 1] - values[a - 1])) for b, q in other.items()) if other else 1.0)
                out[a, size] = won[a]
        return won

    part(0, 2**rounds)
    return out


def test_sizes(spark):
    rows, want = [], {}
    for pool, n in enumerate((1, 2, 3, 5, 8, 12, 16, 21)):
        values = [math.sin(7 * pool + 3 * i) for i in range(n)]
        rows += [(pool, 100 * pool + i, v, i + 1) for i, v in enumerate(values)]
        want |= {(pool, 100 * pool + seed - 1, k): p for (seed, k), p in _through(values).items()}
    got = {(r.pool, r.id, r.round): r.through for r in bracket(spark.createDataFrame(rows, "pool int, id int, v double, seed int")).collect()}
    assert got.keys() == want.keys()
    for k, p in got.items():
        assert p == pytest.approx(want[k], abs=1e-12), k
