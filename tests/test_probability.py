import pytest
from pyspark.sql import functions as F

from courtside.functions import probability as P
from courtside.operators.fits import paired_map


@pytest.mark.parametrize("target", [11, 15, 21])
def test_race_sums_to_one_and_is_symmetric(spark, target):
    p = spark.createDataFrame([(x / 20,) for x in range(1, 20)], "p double")
    mass = F.aggregate(P.race_pmf(F.col("p"), target), F.lit(0.0), lambda a, s: a + s.prob)
    for r in p.select(mass.alias("m"), P.race_win(F.col("p"), target).alias("w"), P.race_win(1 - F.col("p"), target).alias("l")).collect():
        assert r.m == pytest.approx(1, abs=1e-9) and r.w + r.l == pytest.approx(1, abs=1e-9)


def test_best_of_and_logit(spark):
    r = spark.range(1).select(P.best_of(F.lit(0.5), 3).alias("a"), P.best_of(F.lit(0.5), 5).alias("b"), P.sigmoid(P.logit(F.lit(0.3))).alias("c")).first()
    assert (r.a, r.b) == (0.5, 0.5) and r.c == pytest.approx(0.3)


def test_paired_map_orders_players(spark):
    met = spark.createDataFrame([(1, 2, 9, 10), (2, 3, 8, 10), (1, 3, 9, 10)], "a long, b long, won long, n long")
    v = {r.player: r.value for r in paired_map(met).collect()}
    assert v[1] > v[2] > v[3] and sum(v.values()) == pytest.approx(0, abs=1e-6)
